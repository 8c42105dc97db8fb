"""Log-bilinear language model trained by noise-contrastive estimation, and scores of texts.

*Model.*  Each of ``CONTEXT`` tokens before a place has a vector, which a matrix of its position
carries into one predicted vector; its products with the vectors of classes, and of the words of a class, are
scores, normalised by a softmax over the classes and one over the words of the class.  The vocabulary is the
``CLASSES * WIDTH`` most frequent tokens, ``WIDTH`` of one rank of frequency to a class; one class more stands for
all other tokens, which share its probability by their smoothed counts.  So the probabilities of all known
tokens and of an unknown one add up to 1 after any context.

*Training.*  Counts cover all training texts.  Each of ``ROUNDS`` passes takes the texts of one hash class, so every training text is
seen once; tasks train copies of the model in numpy by noise-contrastive estimation (noise: the class
counts, and the word counts within a class, which the biases start at), and the copies are averaged by their tokens in Spark.
What reaches the driver is the model, whose size is fixed.

*Scores.*  Probabilities are batched matrix products over chunks of texts.  Frequent tokens' counts are broadcast, a table of fixed size;
all others meet their counts in a join, where no token is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, read_table, written
from .simhash import LOWER

CLASSES, WIDTH, SIZE, CONTEXT = 64, 256, 24, 2
VOCABULARY = CLASSES * WIDTH
#: Frequent tokens whose counts are broadcast; the vocabulary is the first of them.
FREQUENT = 1 << 18
ROUNDS, BATCH, NOISE, RATE, TURN_RATE = 2, 1 << 13, 16, 0.4, 0.1
#: Tokens that are worked on at once, and values in a row of a model that is sent.
CHUNK, PART = 1 << 18, 1 << 12
#: The end of a text, a token that no word equals.
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(), END]


def count_tokens(texts: DataFrame, most: int = 1 << 18) -> DataFrame:
    """``(token, n)`` of all rows of ``texts`` (one string column); a task holds ``most`` different tokens at a time and a text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens_of(text.as_py()))
                if len(held) >= most:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """``words`` are context vectors (the vocabulary, any other token, the start), ``turns`` a matrix for each position back, and the
    rest vectors and biases of classes (the last: other tokens) and of words, in classes by rank."""

    words: np.ndarray
    turns: np.ndarray
    class_vectors: np.ndarray
    class_bias: np.ndarray
    word_vectors: np.ndarray
    word_bias: np.ndarray


def start_model(counts: np.ndarray, total: int, size: int = SIZE, seed: int = 5) -> Model:
    """The model of plain frequencies: vectors of small random numbers, biases from ``counts`` of the vocabulary (0: no such word) and all tokens."""
    rng = np.random.default_rng(seed)
    by_class = counts.reshape(CLASSES, WIDTH).astype(float)
    held = np.append(by_class.sum(axis=1), max(total - by_class.sum(), 0.0))
    classes = np.where(held > 0, np.log(np.maximum(held, 1)) - np.log(max(held.sum(), 1.0)), -30.0)
    classes[-1] = max(classes[-1], -np.log(held.sum() + 2.0))  # an unknown token is possible
    words = np.where(by_class > 0, np.log(np.maximum(by_class, 1)) - np.log(np.maximum(by_class.sum(axis=1, keepdims=True), 1)), -30.0)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    turns = np.stack([np.eye(size, dtype=np.float32) / (i + 1) for i in range(CONTEXT)])
    return Model(draw(VOCABULARY + 2, size), turns, draw(CLASSES + 1, size), classes.astype(np.float32), draw(VOCABULARY, size), words.ravel().astype(np.float32))


def contexts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token, those before it in its text (a row for each position back); ``starts`` are the texts' first tokens."""
    first = np.zeros(len(ids), dtype=np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)
    at = np.arange(len(ids))
    return np.stack([np.where(at - i >= first, ids[np.maximum(at - i, 0)], VOCABULARY + 1) for i in range(1, CONTEXT + 1)])


def predicted(model: Model, before: np.ndarray) -> np.ndarray:
    return sum(model.words[b] @ turn for b, turn in zip(before, model.turns, strict=True))


def class_spans(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(class, first, end)`` of each class among sorted ids of the vocabulary."""
    cuts = np.searchsorted(ids, np.arange(CLASSES + 1) * WIDTH)
    return [(c, cuts[c], cuts[c + 1]) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]


def log_softmax_at(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithms of the softmax of each row at one column; ``scores`` is overwritten."""
    chosen = scores[np.arange(len(at)), at]
    if scores.max(initial=0.0) > 60:  # beyond that the sum could overflow
        top = scores.max(axis=1)
        scores -= top[:, None]
        chosen = chosen - top
    np.exp(scores, out=scores)
    return chosen - np.log(scores @ np.ones(scores.shape[1], dtype=scores.dtype))


def with_bias(vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Vectors with their bias as one more component, so that a product holds it."""
    return np.column_stack([vectors, bias])


def log_probs(model: Model, ids: np.ndarray, before: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Natural logarithms of each token's probability; for other tokens (id ``VOCABULARY``), of their class."""
    out, order = np.empty(len(ids)), np.argsort(ids.astype(np.int16 if VOCABULARY < 1 << 15 else np.int32), kind="stable")
    classes, words = with_bias(model.class_vectors, model.class_bias), with_bias(model.word_vectors, model.word_bias)
    for a in range(0, len(ids), chunk):
        some = order[a : a + chunk]
        own, hidden = ids[some], predicted(model, before[:, some])
        hidden = np.column_stack([hidden, np.ones(len(own), dtype=hidden.dtype)])
        found = log_softmax_at(hidden @ classes.T, np.minimum(own // WIDTH, CLASSES))
        for c, i, j in class_spans(own):
            found[i:j] += log_softmax_at(hidden[i:j] @ words[c * WIDTH : (c + 1) * WIDTH].T, own[i:j] - c * WIDTH)
        out[some] = found
    return out


def _summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[firsts], np.add.reduceat(rows[order], firsts, axis=0)


class Trainer:
    """Noise-contrastive estimation on mini-batches, with Adagrad steps."""

    def __init__(self, model: Model, seed: int, rate: float = RATE, noise: int = NOISE) -> None:
        self.model = Model(*(a.copy() for a in model))
        self.squares = Model(*(np.full_like(a, 1e-2) for a in model))
        self.rng, self.rate, self.noise = np.random.default_rng(seed), rate, noise
        # the noise: what the biases of the first model say
        self.class_noise = np.exp(model.class_bias.astype(float)) / np.exp(model.class_bias.astype(float)).sum()
        words = np.exp(model.word_bias.astype(float)).reshape(CLASSES, WIDTH)
        self.word_noise = words / words.sum(axis=1, keepdims=True)
        self.word_steps = self.word_noise.cumsum(axis=1)

    def step(self, field: str, at, grad: np.ndarray, share: float = 1.0) -> None:
        values, squares = getattr(self.model, field), getattr(self.squares, field)
        squares[at] += grad * grad
        values[at] -= share * self.rate * grad / np.sqrt(squares[at])

    def contrast(self, hidden: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray, noise: np.ndarray, chance: np.ndarray):
        """Gradients of one contrast of true ``at`` and drawn ``noise``: by hidden rows, by the true ones' score, by noise vectors and biases."""
        shift = np.log(len(noise) * chance + 1e-30).astype(np.float32)
        level, own, drawn = bias - shift, vectors[at], vectors[noise]
        true = -1 / (1 + np.exp(np.einsum("ij,ij->i", hidden, own) + level[at]))
        false = 1 / (1 + np.exp(-level[noise] - hidden @ drawn.T))
        own *= true[:, None]
        own += false @ drawn
        return own, true, false.T @ hidden, false.sum(axis=0)

    def batch(self, ids: np.ndarray, before: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, before = ids[order], before[:, order]
        m, n = self.model, np.float32(len(ids))
        inputs = [m.words[b] for b in before]
        hidden = sum(x @ turn for x, turn in zip(inputs, m.turns, strict=True))
        classes = np.minimum(ids // WIDTH, CLASSES)
        drawn = self.rng.choice(CLASSES + 1, self.noise, p=self.class_noise)
        back, true, by_noise, by_bias = self.contrast(hidden, m.class_vectors, m.class_bias, classes, drawn, self.class_noise)
        vectors, biases = np.zeros_like(m.class_vectors), np.zeros_like(m.class_bias)
        at, sums = _summed(classes, true[:, None] * hidden)
        vectors[at] += sums
        np.add.at(vectors, drawn, by_noise)
        np.add.at(biases, drawn, by_bias)
        biases += np.bincount(classes, true, CLASSES + 1).astype(np.float32)
        self.step("class_vectors", slice(None), vectors / n)
        self.step("class_bias", slice(None), biases / n)
        word_rows, word_biases, touched = [], [], []
        for c, i, j in class_spans(ids):
            own, span = hidden[i:j], slice(c * WIDTH, (c + 1) * WIDTH)
            drawn = np.minimum(np.searchsorted(self.word_steps[c], self.rng.random(self.noise)), WIDTH - 1)
            place = ids[i:j] - c * WIDTH
            more, true, by_noise, by_bias = self.contrast(own, m.word_vectors[span], m.word_bias[span], place, drawn, self.word_noise[c])
            back[i:j] += more
            touched += [ids[i:j], drawn + c * WIDTH]
            word_rows += [true[:, None] * own, by_noise]
            word_biases += [true, by_bias]
        if touched:
            at, sums = _summed(np.concatenate(touched), np.column_stack([np.concatenate(word_rows), np.concatenate(word_biases)]))
            self.step("word_vectors", at, sums[:, :-1] / n)
            self.step("word_bias", at, sums[:, -1] / n)
        by_word = [back @ turn.T for turn in m.turns]
        self.step("turns", slice(None), np.stack([x.T @ back for x in inputs]) / n, TURN_RATE)  # every token moves these
        at, sums = _summed(before.ravel(), np.concatenate(by_word))
        self.step("words", at, sums / n)

    def learn(self, ids: np.ndarray, before: np.ndarray) -> None:
        order = self.rng.permutation(len(ids))
        for a in range(0, len(ids), BATCH):
            with np.errstate(over="ignore"):  # a far score is a certain one
                self.batch(ids[order[a : a + BATCH]], before[:, order[a : a + BATCH]])


def chunks(batches: Iterator[pa.RecordBatch], column: int, places: dict[bytes, int], chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """``(rows, places, starts, tokens)`` of runs of whole texts of about ``chunk`` tokens; the place of an infrequent token is -1."""
    tokens: list[bytes] = []
    starts: list[int] = []

    def out():
        ids = np.fromiter(map(places.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        return len(starts), ids, np.array(starts, dtype=np.int64), tokens

    for batch in batches:
        for text in batch.column(column):
            starts.append(len(tokens))
            tokens += tokens_of(text.as_py())
            if len(tokens) >= chunk:
                yield out()
                tokens, starts = [], []
    if starts:
        yield out()


def in_vocabulary(places: np.ndarray) -> np.ndarray:
    return np.where((places >= 0) & (places < VOCABULARY), places, VOCABULARY)


def shards(total: int) -> int:
    """Tasks of a training pass: the square root of the millions of tokens, so that copies and what each learns from both grow with the corpus."""
    return max(1, int(np.ceil(np.sqrt(total / 1e6))))


def train(texts: DataFrame, model: Model, frequent: list[bytes], total: int, passes: int = ROUNDS) -> Model:
    """``model`` after ``passes`` over ``texts`` (columns text and part, a long that deals the texts out to passes)."""
    context = texts.sparkSession.sparkContext
    places_b = context.broadcast(frequent[:VOCABULARY])
    for number in range(passes):
        model_b = context.broadcast(tuple(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(Model(*model_b.value), seed=1000 * number + TaskContext.get().partitionId())
            places, seen = {w: i for i, w in enumerate(places_b.value)}, 0
            for _, at, starts, _ in chunks(batches, 0, places):
                ids = in_vocabulary(at)
                trainer.learn(ids, contexts(ids, starts))
                seen += len(ids)
            if seen:
                values = np.concatenate([(new - old).ravel() for new, old in zip(trainer.model, model_b.value, strict=True)]) * np.float64(seen)
                rows = [values[i : i + PART].astype(np.float32).tobytes() for i in range(0, len(values), PART)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([seen] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["part", "seen", "change"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            seen: Counter = Counter()
            for batch in batches:
                for part, n, change in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    values = np.frombuffer(change.as_py(), dtype=np.float32).astype(np.float64)
                    sums[part] = sums[part] + values if part in sums else values
                    seen[part] += n
            out = [(sums[p] / seen[p]).astype(np.float32).tobytes() for p in sums]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], names=["part", "change"])

        own = texts.filter(F.pmod("part", F.lit(passes)) == number).select("text").coalesce(shards(total // passes))
        changes = written(own.mapInArrow(run, "part int, seen long, change binary"), "changes")
        mean = changes.repartition("part").mapInArrow(add, "part int, change binary").toArrow()  # the model's size
        model_b.destroy()
        if not len(mean):
            continue
        values = np.frombuffer(b"".join(mean.sort_by("part")["change"].to_pylist()), dtype=np.float32)
        ends = np.cumsum([a.size for a in model])
        model = Model(*(old + values[e - old.size : e].reshape(old.shape) for old, e in zip(model, ends, strict=True)))
    return model


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, learned from the rows that are not ``held_out``.

    ``base_score`` is the smoothed unigram model's log10 probability, ``score`` the log-bilinear model's.  A null text is
    an empty one, of one token, the end.  Without rows to learn from every token is unknown and both scores are those of one
    unknown kind.  Repeated rows stay repeated and are learned from as often as they come; a null id is not held out.  Equal counts
    rank by the token's bytes.  An empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    known = rows.filter("not held_out")
    counts = written(count_tokens(known.select("text")), "token_counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(frequent).toArrow()  # of fixed size
    tokens, numbers = top["token"].to_pylist(), top["n"].to_numpy().astype(np.int64)
    least = (int(numbers[-1]), tokens[-1]) if len(tokens) else (0, b"")
    vocabulary = np.zeros(VOCABULARY, dtype=np.int64)
    vocabulary[: min(len(numbers), VOCABULARY)] = numbers[:VOCABULARY]
    model = start_model(vocabulary, total)
    model = train(known.select("text", F.xxhash64("text", "doc_id").alias("part")), model, tokens, total)
    # the tokens outside of the vocabulary share the last class by their smoothed counts, one unknown kind among them
    other = float(total - vocabulary.sum()) + 0.5 * (kinds - int((vocabulary > 0).sum()) + 1)
    model_b, tokens_b = spark.sparkContext.broadcast(tuple(model)), spark.sparkContext.broadcast((tokens, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (names, held) = Model(*model_b.value), tokens_b.value
        places, logs = {w: i for i, w in enumerate(names)}, np.log10(np.append(held, 0) + 0.5)
        for batch in batches:
            done = 0
            for n, at, starts, words in chunks(iter([batch]), 3, places):
                ids = in_vocabulary(at)
                each = log_probs(own, ids, contexts(ids, starts)) / np.log(10)
                base = np.where(at >= 0, logs[at], 0.0)
                each += np.where((ids == VOCABULARY) & (at >= 0), base, 0.0) - np.where(ids == VOCABULARY, np.log10(other), 0.0)
                rare = np.flatnonzero(at < 0)
                cuts = np.searchsorted(rare, np.append(starts, len(ids)))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array([words[i] for i in rare], pa.binary()))
                ends = np.append(starts[1:], len(ids))
                sums = [np.add.reduceat(x, starts) for x in ((at >= 0).astype(np.int64), base, each)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(done, n) for i in range(3)), pa.array(ends - starts), *(pa.array(s) for s in sums), lists], names=names_of
                )
                done += n

    kind = rows.schema["doc_id"].dataType.simpleString()
    names_of = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"]
    told = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    told = written(told.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<binary>"), "scored")
    model_b.destroy()
    tokens_b.destroy()
    rest = counts.filter((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("token") > F.lit(least[1]))))
    rare = told.select("row", F.explode("rare").alias("token"))
    found = rare.join(broadcast_if_small(rest), "token", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return told.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (kinds + 1))))).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def op13_log_bilinear(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 modulo 5 is not 1."""
    return score_texts(read_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
