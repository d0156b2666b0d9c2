"""Operator 8: language model scoring with a hidden Markov model.

Tokens are lower-cased words, then one end per text. The model learns from the
texts that aren't held out. Latent states emit symbols: the ``TOP`` most
frequent words, the end, and ``CLASSES`` classes of all other words by their
last letters; a class then emits its word by smoothed frequency, unseen words
included, so the model is a distribution over all texts. Baum-Welch runs over
every training token: tasks gather expected counts of their texts, blocks of
them are summed by key, and only the new parameters, whose size is fixed,
reach the driver and go out again by broadcast. A text's likelihood is the
exact scaled forward recursion over its whole sequence.

Word counts cover the whole training corpus and are as long as its
vocabulary. Only the ``KNOWN`` most frequent words (a fixed bound) are
broadcast with their counts; all other words are counted per text and joined
to the count table by a shuffle, so nothing that grows is broadcast, and no
frequent word is a join key.

Long texts are cut into pieces of ``PIECE`` tokens for the expectation step
only, to bound its memory; every piece takes part.

Cases: null text counts as empty and scores its end alone. A null doc_id
belongs to the training texts. Repeated rows train and score each. With no
training text all counts are 0 and scores come from smoothing alone. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import arrow_map, table, text_bytes, written

# --- fixed values ----------------------------------------------------------
STATES = 8
ROUNDS = 4
TOP, CLASSES, KNOWN = 32_768, 255, 131_072
ADD = 0.1  # smoothing of word counts, in the base score and inside classes
EMISSION_ADD, TRANSITION_ADD = 0.01, 1.0
PIECE = 1 << 14  # steps between the forward messages that are kept
CELLS = 1_000_000  # of one expectation step's arrays
FLUSH_WORDS = 400_000
BLOCK = 2048  # symbols of a row of expected counts
# ---------------------------------------------------------------------------
END = TOP
SYMBOLS = TOP + 1 + CLASSES


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _class_column(word: str):
    return F.pmod(F.crc32(F.substring(F.col(word).cast("binary"), -3, 3)), F.lit(CLASSES)).cast("int")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all rows of ``texts``; the null word counts the ends."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ends = Counter(), 0
        for batch in batches:
            for text in text_bytes(batch):
                counts.update(text.lower().split())
                ends += 1
                if len(counts) >= FLUSH_WORDS:
                    yield emit(counts, 0)
                    counts.clear()
        if ends:
            yield emit(counts, ends)

    def emit(counts: Counter, ends: int) -> pa.RecordBatch:
        words, n = list(counts), list(counts.values())
        if ends:
            words, n = [*words, None], [*n, ends]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(stream, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The bounded part of the counts: symbol and log10 of the smoothed count
    of the most frequent words; totals of the classes."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
        self.N, self.V = total["N"], total["V"]
        ends = counts.where("word IS NULL").first()
        self.ends = ends["n"] if ends else 0
        words = counts.where("word IS NOT NULL")
        # The most frequent words, by a cut between bins of like frequency:
        # no more than KNOWN rows come to the driver, whatever the input.
        bin_of = F.floor(F.log2("n") * 64)
        left, cut = KNOWN, None
        for r in sorted(words.groupBy(bin_of.alias("b")).agg(F.count("*").alias("v")).collect(), reverse=True):
            if r["v"] > left:
                break
            left, cut = left - r["v"], r["b"]
        frequent = words.where(bin_of >= cut).collect() if cut is not None else []
        known = sorted(frequent, key=lambda r: (-r["n"], r["word"]))
        self.known = {}
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in words.groupBy(_class_column("word").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.class_n[r["c"]], self.class_v[r["c"]] = r["n"], r["v"]
        self.symbol_n = np.zeros(SYMBOLS)
        for i, r in enumerate(known):
            word = r["word"].encode()
            c = class_of(word)
            if i < TOP:
                self.class_n[c] -= r["n"]
                self.class_v[c] -= 1
                self.symbol_n[i] = r["n"]
            self.known[word] = (i if i < TOP else END + 1 + c, math.log10(r["n"] + ADD), i >= TOP)
        self.symbol_n[END] = self.ends
        self.symbol_n[END + 1 :] = self.class_n
        self.words = [r["word"].encode() for r in known[:TOP]]
        self.class_log = np.log10(self.class_n + ADD * (self.class_v + 1))  # denominator inside a class
        self.base_log = math.log10(self.N + ADD * (self.V + 1))
        self.end_log = math.log10(self.ends + ADD)


class _Row(dict):
    """word -> (symbol, log10 of smoothed count, member of a class, counted)."""

    def __init__(self, known: dict):
        super().__init__(known)

    def __missing__(self, word: bytes):
        return END + 1 + class_of(word), None, True


SYMBOL_ROWS = "doc_id long, held_out boolean, n_tokens long, syms binary, n_known long, base_log double, class_log double, rare_words array<string>, rare_n array<int>"


def symbols(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each text as symbols (2 bytes each), the parts of its scores that the
    known words give, and its other words with their numbers."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary.known, vocabulary.class_log, vocabulary.end_log, vocabulary.ends))
    cache: dict = {}

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, class_log, end_log, ends = shared.value
        if "look" not in cache:
            cache["look"] = _Row(known)
        look = cache["look"]
        cols: list[list] = [[] for _ in range(7)]
        for text in text_bytes(batch):
            words = text.lower().split()
            n, base, inside, rare_w, rare_n = 0, end_log, 0.0, [], []
            for w, k in Counter(words).items():
                sym, log, member = look[w]
                if log is None:
                    rare_w.append(w)
                    rare_n.append(k)
                    inside -= k * class_log[sym - END - 1]
                else:
                    n += k
                    base += k * log
                    if member:
                        inside += k * (log - class_log[sym - END - 1])
            syms = np.fromiter((look[w][0] for w in words), np.uint16, len(words))
            values = (len(words) + 1, np.append(syms, np.uint16(END)).tobytes(), n + (ends > 0), base, inside, rare_w, rare_n)
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        arrays[5] = arrays[5].cast(pa.list_(pa.string()))
        names = [x.split()[0] for x in SYMBOL_ROWS.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], names)

    return arrow_map(rows, over, SYMBOL_ROWS)


class Model:
    """start (S), move (S, S) and emit (symbols, S), as probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def first_model(vocabulary: Vocabulary) -> Model:
    """Every state emits by frequency, leaning to the words whose ending
    belongs to it; states tend to stay."""
    endings = [zlib.crc32(w[-2:]) for w in vocabulary.words]
    endings += [7 * i for i in range(TOP - len(endings))] + [0] + [13 * c for c in range(CLASSES)]
    lean = np.ones((SYMBOLS, STATES))
    lean[np.arange(SYMBOLS), np.asarray(endings) % STATES] = 4.0
    lean[END] = 1.0
    emit = (vocabulary.symbol_n[:, None] + EMISSION_ADD) * lean
    move = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def batches_by_length(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    """Indices of sequences of like length, longest first, in groups whose
    padded arrays stay below CELLS."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    group: list[int] = []
    for i in order:
        if group and (len(group) + 1) * len(seqs[group[0]]) > CELLS:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by time, and how many sequences (longest first) still run."""
    lens = np.array([len(s) for s in seqs])
    x = np.full((lens[0], len(seqs)), END, np.int32)
    for k, s in enumerate(seqs):
        x[: len(s), k] = s
    return x, np.searchsorted(-lens, -np.arange(lens[0]), side="left")


def log_likelihoods(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each symbol sequence, by the scaled forward
    recursion."""
    out = np.zeros(len(seqs))
    for group in batches_by_length(seqs):
        x, running = padded([seqs[i] for i in group])
        total = np.zeros(len(group))
        a = model.start * model.emit[x[0]]
        for t in range(len(x)):
            if t:
                k = running[t]
                a = (a[:k] @ model.move) * model.emit[x[t, :k]]
            scale = a.sum(axis=1)
            a /= scale[:, None]
            total[: len(scale)] += np.log10(scale)
        out[group] = total
    return out


def expected_counts(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the sequences. Of the forward
    messages only those at the start of every ``PIECE`` steps are kept; a
    piece's others are made again when the backward messages reach it. So
    messages cross all pieces of a text, in memory of a piece and its marks."""
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
    p, a_move, a_emit = model.start.astype(np.float32), model.move.astype(np.float32), model.emit.astype(np.float32)
    for group in batches_by_length(seqs):
        x, running = padded([seqs[i] for i in group])
        steps = len(x)

        def forward_from(a, begin: int, end: int) -> list[np.ndarray]:
            """Messages of steps begin to end, given that of begin."""
            out = [a]
            for t in range(begin + 1, end):
                k = running[t]  # noqa: B023
                a = (a[:k] @ a_move) * a_emit[x[t, :k]]  # noqa: B023
                a = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
                out.append(a)
            return out

        a = p * a_emit[x[0]]
        marks = [a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30)]
        for begin in range(0, steps - PIECE, PIECE):
            marks.append(forward_from(marks[-1], begin, begin + PIECE + 1)[-1])
        after = None
        for piece in range(len(marks) - 1, -1, -1):
            begin = piece * PIECE
            alpha = forward_from(marks.pop(), begin, min(steps, begin + PIECE))
            for t in range(begin + len(alpha) - 1, begin - 1, -1):
                a = alpha[t - begin]
                if after is not None:
                    k = len(after)
                    ahead = a_emit[x[t + 1, :k]] * after
                    back = ahead @ a_move.T
                    norm = np.maximum((a[:k] * back).sum(axis=1, keepdims=True), 1e-30)
                    ahead /= norm
                    back /= norm
                    move += a[:k].T @ ahead
                    beta = np.ones_like(a)
                    beta[:k] = back
                    alpha[t - begin] = a * beta
                    after = beta
                else:
                    after = np.ones_like(a)
            gamma = np.concatenate(alpha)
            flat = np.concatenate([x[t, : running[t]] for t in range(begin, begin + len(alpha))])
            for s in range(STATES):
                emit[:, s] += np.bincount(flat, weights=gamma[:, s], minlength=SYMBOLS)
        start += alpha[0].sum(axis=0)
    return start, move * model.move, emit


def train_round(rows: DataFrame, model: Model) -> Model:
    """One Baum-Welch round over the symbol rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
        any_rows = False
        for batch in batches:
            seqs = [np.frombuffer(raw, "<u2") for raw in batch.column("syms").to_pylist()]
            if seqs:
                any_rows = True
                for total, part in zip((start, move, emit), expected_counts(seqs, shared.value), strict=True):
                    total += part
        if any_rows:
            parts = [(-1, np.vstack([start, move]))] + [(b, emit[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-SYMBOLS // BLOCK))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in parts], pa.int32()), pa.array([x.astype(np.float32).tobytes() for _, x in parts], pa.binary())], ["block", "counts"]
            )

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in parts["counts"])
        return pd.DataFrame({"block": parts["block"].iloc[:1], "counts": [total.astype(np.float32).tobytes()]})

    # Summed in two levels, each over about the root of the number of tasks.
    fan = math.ceil(math.sqrt(max(1, len(rows.inputFiles()))))
    gathered = rows.select("syms").mapInArrow(gather, "block int, counts binary")
    for key in (F.pmod(F.spark_partition_id(), F.lit(fan)), F.lit(0)):
        gathered = gathered.groupBy("block", key.alias("_p")).applyInPandas(add, "block int, counts binary")
    emit, start, move = np.zeros((SYMBOLS, STATES)), np.zeros(STATES), np.zeros((STATES, STATES))
    for r in gathered.collect():  # one row a block, of fixed size
        x = np.frombuffer(r["counts"], np.float32).reshape(-1, STATES)
        if r["block"] < 0:
            start += x[0]
            move += x[1:]
        else:
            emit[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] += x
    emit += EMISSION_ADD
    move += TRANSITION_ADD
    start += TRANSITION_ADD
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def forward(rows: DataFrame, model: Model) -> DataFrame:
    """rid and the log10 probability of its symbols."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seqs = [np.frombuffer(x, "<u2") for x in batch.column("syms").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "syms"), pa.array(log_likelihoods(seqs, shared.value))], [c for c in batch.schema.names if c != "syms"] + ["symbols_log"])

    kept = rows.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base_log", "class_log", "syms")
    return arrow_map(kept, over, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, class_log double, symbols_log double")


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out(F.col("doc_id")))
    counts = written(word_counts(rows.where(~F.col("held_out"))))
    vocabulary = Vocabulary(counts)
    coded = written(symbols(rows, vocabulary).withColumn("rid", F.monotonically_increasing_id()))
    model = first_model(vocabulary)
    training = coded.where(~F.col("held_out"))
    for _ in range(rounds):
        model = train_round(training, model)
    rare = coded.select("rid", F.explode(F.arrays_zip("rare_words", "rare_n")).alias("r")).select("rid", F.col("r.rare_words").alias("word"), F.col("r.rare_n").alias("k"))
    found = rare.join(counts.where("word IS NOT NULL"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per_text = found.groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.col("n") + ADD)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rare_known")
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return forward(coded, model).join(per_text, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.N).cast("long").alias("train_tokens"),
        (F.col("base_log") + rare_log - F.col("n_tokens") * F.lit(vocabulary.base_log)).alias("base_score"),
        (F.col("symbols_log") + F.col("class_log") + rare_log).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
