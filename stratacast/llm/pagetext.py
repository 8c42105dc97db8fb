"""Main text of web pages by consensus host paths.

First pass: each page's containers are scored by the text they hold beyond link
text, and vote for their generalised path (tags with class words, digits
masked).  Votes are summed per host in Spark.  Second pass: each page's text is
taken from the containers on its host's winning path, or from the page's own
best container where it has none on that path.

Menus, notices and the like are told by their tags and roles, or where all that a class
and id say points to them.  Where only a part of the words does, as in "notice-board", the
host decides in the same vote: such a path is left out if its text is the same on several pages or is mostly links.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import read_table, written
from .urls import host_of

#: A quote opens a value after ``=`` only; any other is a character of its own, whatever follows.
TOKEN = re.compile(
    r"<!--|<!\[CDATA\[|<[!?]|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*+)(?P<attrs>(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?P<close>>?)",
    re.DOTALL,
)
#: Every attribute, so that what another one's value holds is not read as a class.
ATTR = re.compile(r"(?<![^\s\"'/=])([^\s\"'/=]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
FOR = re.compile(r"(?<![^\s\"'/])for\s*=", re.IGNORECASE)
NAMED = re.compile(r"\b(class|id|role)\Z", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
CONTAINERS = frozenset("html body main article section div td th table tbody tr ul ol dl blockquote center details figure".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre br hr address header footer nav aside form fieldset figcaption summary caption option select legend dialog menu thead tfoot".split()
)
BOILERPLATE_TAGS = frozenset("nav header footer aside head button select svg canvas audio video dialog menu input fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of a class or id that speak for menus, headers, footers, sidebars, notices, adverts, forms and comments,
#: and words of layout that say nothing.
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead banner footer sidebar aside complementary contentinfo notice alert cookie cookies consent gdpr "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion form search searchbox login signup subscribe subscription newsletter "
    "comment comments disqus respond reply replies share sharing social related recommended breadcrumb breadcrumbs pagination pager popup modal overlay toolbar widget skip hidden".split()
)
NEUTRAL_WORDS = frozenset(
    "article area bar block body bottom box btn button buttons col column container content entry global group head holder inner item items js large left link links list "
    "main outer page panel post posts primary right row secondary section site small text top unit wrap wrapper".split()
)
#: Share of the words that must speak for it for an element to be left out without asking the host.
CERTAIN = 0.75
#: What an opening tag closes that was left open, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
FAVOURED = {"article": 3.0, "main": 2.0}
PROSE = ("p", "article", "main", "h1", "h2", "h3", "blockquote", "pre")


class Page:
    """Blocks of text in page order, and the containers that hold ranges of them."""

    def __init__(self, source: str, left_out: frozenset[str] = frozenset()):
        self._start_over(left_out, frozenset())
        self._read(source)
        # a form around the page's text is no form to fill in: with more prose than all the rest has text it is read as any other element
        wide = frozenset(i for i, n in self._form_chars.items() if n > sum(map(len, self.blocks)))
        if wide:
            self._start_over(left_out, wide)
            self._read(source)

    def _start_over(self, left_out: frozenset[str], wide_forms: frozenset[int]) -> None:
        self.blocks: list[str] = []
        #: path, parent, first block, block after the last, score, tag, whether its words are in doubt
        self.nodes: list[list] = [["", -1, 0, 0, 0.0, "", False]]
        #: characters within links, by block
        self.linked: list[int] = []
        self._left_out = left_out
        self._depth: dict[str, int] = {}
        self._parts: list[str] = []
        self._link_chars = 0
        #: tag, node, and whether its text is kept (0), left out (1) or left out for its form alone (2)
        self._open: list[tuple[str, int, int]] = [("", 0, 0)]
        self._links = 0
        self._wide_forms = wide_forms
        self._forms = 0
        self._form_chars: dict[int, int] = {}

    def _read(self, source: str) -> None:
        at, n, last = 0, len(source), source.rfind(">")
        while at < n:
            found = TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            tag = found["tag"]
            if tag is None:
                opening = found[0]
                end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(opening, ">")
                if end == ">" and at > last:  # nothing ends it
                    self._text(opening)
                    continue
                to = source.find(end, at)
                if end == "]]>":
                    self._text(source[at : to if to >= 0 else n])
                at = to + len(end) if to >= 0 else n
                continue
            if not found["close"]:  # no tag; what was read of it is text, so nothing is read twice
                self._text(found[0])
                continue
            tag = tag.lower()
            if found["end"]:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                at = source.find(">", end.end()) + 1 if end and end.end() <= last else n
            else:
                self._start(tag, found["attrs"])
        self._flush()
        while len(self._open) > 1:
            self._pop()
        self.nodes[0][3] = len(self.blocks)

    def _text(self, text: str) -> None:
        dropped = self._open[-1][2]
        if not dropped:
            self._parts.append(text)
            if self._links:
                self._link_chars += len(text)
        elif dropped == 2 and any(self._depth.get(t) for t in PROSE):
            self._form_chars[self._forms] = self._form_chars.get(self._forms, 0) + sum(map(len, text.split()))

    def _flush(self) -> None:
        if not self._parts:
            return
        text = " ".join(entities.unescape("".join(self._parts)).split())
        links, self._parts, self._link_chars = self._link_chars, [], 0
        if text:
            self.blocks.append(text)
            self.linked.append(min(links, len(text)))
            worth, node = len(text) - 2.0 * links, self._open[-1][1]
            while node >= 0 and abs(worth) > 1e-9:
                self.nodes[node][4] += worth
                worth, node = worth / 2, self.nodes[node][1]

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in IMPLIED:
                self._imply(*IMPLIED[tag])
            elif tag != "br":
                self._imply({"p"}, CONTAINERS)
        if tag in VOID:
            return
        _, node, dropped = self._open[-1]
        words, roles = self._named(attrs)
        telling = [w for w in words if w not in NEUTRAL_WORDS and w != tag]
        share = sum(w in BOILERPLATE_WORDS for w in telling) / len(telling) if telling else 0.0
        whole = tag in ("html", "body")
        if tag in BOILERPLATE_TAGS or not whole and (share >= CERTAIN or not BOILERPLATE_ROLES.isdisjoint(roles)):
            dropped = 1
        elif tag == "label" and (self._depth.get("form") or FOR.search(attrs)):  # of a control
            dropped = 1
        elif tag == "form" and not dropped:
            self._forms += 1
            dropped = 0 if self._forms in self._wide_forms else 2
        doubt = 0 < share < CERTAIN and not whole
        if (tag in CONTAINERS or doubt) and not dropped:
            label = ".".join([tag, *(re.sub(r"\d+", "#", w) for w in words)])
            # the path is named by a hash of the path above and its own label, so that deep nesting costs no more
            path = xxhash.xxh64_hexdigest(f"{self.nodes[node][0]}>{label}")
            if doubt and path in self._left_out:
                dropped = 1
            else:
                self.nodes.append([path, node, len(self.blocks), 0, 0.0, tag, doubt])
                node = len(self.nodes) - 1
                if tag not in BLOCKS:  # what stands before it is not its text
                    self._flush()
                    self.nodes[node][2] = len(self.blocks)
        if tag == "a":
            self._links += 1
        self._open.append((tag, node, dropped))
        self._depth[tag] = self._depth.get(tag, 0) + 1

    @staticmethod
    def _named(attrs: str) -> tuple[list[str], list[str]]:
        """Words of class and id, and roles."""
        words: list[str] = []
        roles: list[str] = []
        for m in ATTR.finditer(attrs) if attrs else ():
            if NAMED.search(m[1]):
                found = re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())
                if m[1].lower() == "role":
                    roles += found
                else:
                    words += found
        return words, roles

    def _imply(self, closed: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        if not any(self._depth.get(t) for t in closed):
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] in closed:
                while len(self._open) > i:
                    self._pop()
                return
            if self._open[i][0] in stop:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if not self._depth.get(tag):
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == tag:
                while len(self._open) > i:
                    self._pop()
                return
            if tag not in CONTAINERS and self._open[i][0] in CONTAINERS:
                return

    def _pop(self) -> None:
        tag, node, _ = self._open.pop()
        self._depth[tag] -= 1
        if self.nodes[node][6] and node != self._open[-1][1]:
            self._flush()
        if tag == "a":
            self._links -= 1
        if node != self._open[-1][1]:
            self.nodes[node][3] = len(self.blocks)

    def ranked(self) -> list[tuple[float, int]]:
        """``(score, node)`` of containers with text, best first; ties go to the outer one."""
        scores = [(n[4] * FAVOURED.get(n[5], 1.0), -i) for i, n in enumerate(self.nodes) if n[3] > n[2]]
        return [(s, -i) for s, i in sorted(scores, reverse=True)]

    def doubts(self) -> list[tuple[str, int, int, int]]:
        """``(path, hash of the text, characters, characters in links)`` of elements whose words are in doubt."""
        out = []
        for path, _, first, end, _, _, doubt in self.nodes:
            if doubt and end > first:
                text = "\n".join(self.blocks[first:end])
                out.append((path, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1, len(text), sum(self.linked[first:end])))
        return out

    def text_at(self, path: str | None) -> str:
        """Text of the containers on ``path``, or of the best one if there is none."""
        ranges = [(n[2], n[3]) for n in self.nodes if n[0] == path and n[3] > n[2]] if path is not None else []
        if not ranges:
            best = self.ranked()
            ranges = [tuple(self.nodes[best[0][1]][2:4])] if best else []
        out, at = [], 0
        for a, b in ranges:
            out += self.blocks[max(a, at) : b]
            at = max(at, b)
        return "\n".join(out)


def host_paths(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``(host, path, left_out)``: the path with most votes of each host's pages, and the doubtful paths that the host leaves out.

    A page gives its containers their shares of all positive scores, in millionths; equal sums go
    to the later path.  A doubtful path is left out if several pages have it with
    one text, or if most of its characters are in links.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("host", pa.string()), ("path", pa.string()), ("share", pa.int64()), ("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())]
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(source.as_py() or "")
                best = [(s, page.nodes[i][0]) for s, i in page.ranked() if s > 0]
                total = sum(s for s, _ in best)
                rows += [(host, path, int(1_000_000 * s / total), None, None, None) for s, path in best]
                rows += [(host, path, None, text, chars, linked) for path, text, chars, linked in page.doubts()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    cast = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    sums = (
        cast.mapInArrow(vote, "host string, path string, share long, text long, chars long, linked long")
        .groupBy("host", "path")
        .agg(F.sum("share").alias("share"), F.count("text").alias("pages"), F.min("text").alias("low"), F.max("text").alias("high"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    )
    alike = (F.col("pages") > 1) & (F.col("low") == F.col("high"))
    out = (F.col("pages") > 0) & (alike | (2 * F.col("linked") > F.col("chars")))
    return sums.groupBy("host").agg(
        F.max(F.when(F.col("share").isNotNull() & ~out, F.struct("share", "path"))).alias("best"), F.collect_list(F.when(out, F.col("path"))).alias("left_out")
    ).select("host", F.col("best.path").alias("path"), "left_out")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: ``page_id, url, text, n_chars``.

    Blocks are joined by a newline, white space inside one is a single space; a line
    break ends a block.  Null and empty pages, and pages without text outside
    menus and the like, have an empty text.  Pages without a host form one host.
    Repeated rows stay repeated; other columns are ignored; an empty table gives an empty result.
    """
    paths = written(host_paths(pages, url_col, html_col), "host_paths")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            texts = [Page(s.as_py() or "", frozenset(out or ())).text_at(p) for s, p, out in given]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host")
    ).join(paths, "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "path", "left_out").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


def op5_page_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(read_table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1), '\s+', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, ' *\n[ \n]*', chr(10), 'g'), chr(10) || ' ') AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
