"""URL verdicts from pattern rules indexed by their rarest literal token.

Every rule, a host/path rule as much as a word or an expression, is a regular expression
with literal tokens that any URL it matches must hold; they are derived from the rule.
Tokens of rules are counted over all URLs, each rule is filed under its rarest one, and
a URL's tokens fetch its candidate rules; only those are run.  The index is a constant of
the plan, so each URL is judged where it is read, by DataFrame functions only.
"""

from __future__ import annotations

import json
import re
import zlib
from re import _parser as syntax
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import LOWER, UPPER
from .runtime import read_table


class Rule(NamedTuple):
    """``regex`` is searched in ``host + path``; ``tokens`` are literals that every match holds as whole tokens.

    ``name`` is reported for host/path rules and null for patterns; ``rank``
    orders the rules that match one URL: the largest decides.
    """

    regex: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None
    rank: int


#: The host and path rules of the contract, in the syntax of ``read_rules``.
HOST_RULES = """
||com/en/
@@||example.com/en/7
@@||net/de/
||example.net/de/8
||org/es/
"""
#: Words that mark spam where they are a whole token of a host or path.
SPAM_WORDS = (
    "adult bets betting bingo casino cialis escort gambling jackpot levitra loans lottery pharmacy pills poker porn replica roulette sex slots spam viagra warez xxx"
)


def tokens_in(text: str) -> list[str]:
    return [t for t in re.split(r"[^0-9a-z]+", text.translate(str.maketrans(UPPER, LOWER))) if t]


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A host and all its subdomains, for paths that start with ``path``; the longest rule wins, block before allow."""
    host = host.translate(str.maketrans(UPPER, LOWER))
    # the last token of a path prefix may go on in the URL, so it is no literal token unless a separator ends it
    whole = tokens_in(host) + [t for p in re.split(r"[^0-9A-Za-z]+", path)[:-1] for t in tokens_in(p)]
    name = host + path
    rank = 1_000_000 + 2 * len(name) + (verdict == "block")
    return Rule(rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), verdict, name, rank)


def expression_rule(regex: str, verdict: str = "block") -> Rule:
    """A regular expression; block before allow."""
    return Rule(regex, sure_tokens(regex), verdict, None, int(verdict == "block"))


def word_rule(text: str, verdict: str = "block") -> Rule:
    """A literal, in either case, that no letter or digit goes on from; ``*`` stands for anything."""
    regex = r"(?i)(?<![0-9A-Za-z])" + ".*".join(map(re.escape, text.split("*"))) + r"(?![0-9A-Za-z])"
    return Rule(regex, sure_tokens(rf"\b{'.*'.join(map(re.escape, text.split('*')))}\b"), verdict, None, int(verdict == "block"))


def sure_tokens(regex: str) -> tuple[str, ...]:
    """Literals that every match of ``regex`` holds as whole tokens: runs of letters and digits, outside of
    choices and repeats, between two places where the expression itself has a boundary or another character.

    An expression that only Java's syntax knows has none, so it is tried on every URL."""
    out: list[str] = []
    run: str | None = None  # None: what came last may be a part of a token

    def plain(c: int) -> bool:
        return chr(c).isascii() and chr(c).isalnum()

    def walk(nodes) -> None:
        nonlocal run
        for kind, value in nodes:
            name = str(kind)
            if name == "LITERAL" and plain(value):
                run = None if run is None else run + chr(value)
            elif name == "LITERAL" or name == "AT" and str(value) != "AT_NON_BOUNDARY" or name == "IN" and all(str(k) == "LITERAL" and not plain(v) for k, v in value):
                if run:
                    out.append(run)
                run = ""
            elif name == "SUBPATTERN":
                walk(value[-1])
            else:
                run = None

    try:
        parsed = syntax.parse(regex)
    except (re.error, OverflowError, RecursionError):
        return ()
    if not parsed.state.flags & re.VERBOSE:
        walk(parsed)
    return tuple(t.translate(str.maketrans(UPPER, LOWER)) for t in out)


def read_rules(text: str) -> list[Rule]:
    """Rules of a filter list, one to a line; ``@@`` before one makes it allow instead of block.

    ``||host/path`` is a host with its subdomains and a path prefix, ``/.../`` a regular
    expression, and anything else a literal in which ``*`` stands for anything.  Empty lines and those after ``!`` are left out.
    """
    rules = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("!"):
            continue
        verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        if body.startswith("||"):
            host, slash, path = body[2:].partition("/")
            rules.append(host_rule(verdict, host, slash + path))
        elif len(body) > 2 and body[0] == body[-1] == "/":
            rules.append(expression_rule(body[1:-1], verdict))
        else:
            rules.append(word_rule(body, verdict))
    return rules


def production_rules() -> list[Rule]:
    return read_rules(HOST_RULES) + read_rules("\n".join(SPAM_WORDS.split()))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(place: Column) -> Column:
    """The distinct tokens of a host and path, and the empty one, under which rules without a token are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(place, UPPER, LOWER), "[^0-9a-z]+")))


def rule_index(rules: list[Rule], places: DataFrame) -> tuple[Column, int]:
    """A hash table as a constant, and its size: an array of buckets of ``(token, regex, rank, rule, verdict)``, each rule under its token that the fewest places hold.

    ``places`` has a column ``tokens``.  What comes to the driver is a count for each token of a rule.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    table = places.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    found = places.select(F.explode("tokens").alias("token")).join(F.broadcast(table), "token").groupBy("token").count().collect() if wanted else []
    counts = {r["token"]: r["count"] for r in found}
    size = max(1, 2 * len(rules))
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for r in rules:
        token = min(r.tokens or ("",), key=lambda t: (counts.get(t, 0), t))
        buckets[zlib.crc32(token.encode()) % size].append({"token": token, "regex": r.regex, "rank": r.rank, "rule": r.name, "verdict": r.verdict})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<token:string,regex:string,rank:int,rule:string,verdict:string>>>"), size


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page row: ``page_id, host, path, rule, verdict``.

    The matching rule of the largest rank decides; ``rule`` is its name (null for
    patterns), ``verdict`` is ``default`` where none matches.  A null URL, or one
    without ``://``, has an empty host and path and matches only rules that match
    the empty string.  Repeated rows stay repeated; other columns are ignored; an empty table gives an empty result.
    The rules are a list in the driver, so the index is bounded by it; URLs are neither shuffled nor joined.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    place = F.concat("host", "path")
    rows = rows.withColumn("tokens", url_tokens(place))
    index, size = rule_index(rules, rows)

    def candidates(token: Column) -> Column:
        bucket = F.element_at(index, (F.crc32(token.cast("binary")) % size + 1).cast("int"))
        return F.filter(bucket, lambda r: (r["token"] == token) & F.rlike(place, r["regex"]))

    fits = F.flatten(F.transform("tokens", candidates))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["rank"].alias("rank"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = rows.select("page_id", "host", "path", best.alias("best"))
    return judged.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs from the host rules and the spam words."""
    return judge_urls(read_table(spark, sf_dir, "pages"), production_rules())


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT DISTINCT host, path, arg_max(struct_pack(rule := h || q, verdict := verdict), length(h || q)) AS b
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1, 2)
SELECT p.page_id, p.host, p.path, b.rule AS rule,
       coalesce(b.verdict, CASE WHEN regexp_matches(p.host || p.path,
         '(^|[^0-9A-Za-z])(' || replace('$WORDS', ' ', '|') || ')([^0-9A-Za-z]|$)', 'i') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (host, path)
""".replace("$WORDS", SPAM_WORDS)
