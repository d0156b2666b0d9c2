"""Operator 13: alignment of two tokenizers by inverted pair bitmaps.

A text, with one space before it, is encoded by a byte-level vocabulary (A) and
a piece vocabulary (B). Byte offsets where tokens of both end cut it into
groups; every A token is linked with every B token of its group. An id pair's
count is the number of documents that hold it linked.

* **Encoding.** Both tokenizers end a token before a single space or line feed
  between other characters (checked against the vocabularies; otherwise texts
  stay whole), so a text is a sequence of units cut there. What a unit becomes is
  kept per worker, new units are encoded many at a time.
* **Inverted bitmaps.** Up to ``RUN_POSTINGS`` postings of consecutive documents
  of a partition make a run. Per pair it keeps bit planes over its documents:
  plane k holds the documents whose number of links has bit k. A pair of few
  documents keeps a plane as a list of places, any other as a bitmap. The planes
  OR-ed give a pair's documents, popcounts its document and link counts.
* **Scores.** Counts of all runs are added per pair (each document lies in one
  run); the highest of an A id follows. Each run then gets the scores of its
  own pairs and its postings return them to its documents, plane by plane.

Only (run, pair) rows and runs are shuffled, never postings; a task holds one
run at a time, however frequent a pair or long a text is. The highest counts by
A id, at most the vocabulary's size, are broadcast, as are the two model files.

Cases: texts that are null, empty or not given back by A or B byte by byte have
no tokens. Every row is a document of its own, repeated rows and null ids too.
An empty table gives no rows. Other columns are ignored, whatever their names.
Strings of special tokens inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import table, written

# --- fixed values ----------------------------------------------------------
A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_UNITS = 120_000
TEXT_AT_ONCE, JOINED = 1 << 22, 1 << 17  # characters looked up, and encoded, together
RUN_POSTINGS, RUN_DOCS = 4_000_000, 1 << 16
PLACE_BITS = 16  # of a place in a list
LONG_UNIT = 1000  # characters from which a unit is encoded alone
# The split of a byte-level pre-tokenizer.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BIG_GROUP = 1 << 16  # links of a group that are counted by distinct ids
# ---------------------------------------------------------------------------
_UNIT = re.compile(r"[ \n]\S+")
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
_MODELS: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 characters themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    return keys[first], np.add.reduceat(values, first)


class Units:
    """What units become: counts, text form of the groups and linked pairs
    (unit ``i`` has the pairs ``at[i]`` to ``at[i + 1]``)."""

    def __init__(self, counts: np.ndarray, forms: list[bytes], ok: np.ndarray, at: np.ndarray, codes: np.ndarray, times: np.ndarray):
        self.counts, self.forms, self.ok, self.at, self.codes, self.times = counts, forms, ok, at, codes, times

    @staticmethod
    def none(n: int = 0) -> Units:
        """``n`` units that A or B doesn't give back."""
        return Units(np.zeros((n, 4), np.int64), [b""] * n, np.zeros(n, bool), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    @staticmethod
    def of(parts: list[Units]) -> Units:
        joined = lambda name: np.concatenate([getattr(p, name) for p in parts])
        begin = _offsets(np.array([p.at[-1] for p in parts]))
        at = np.concatenate([[0], *(p.at[1:] + b for p, b in zip(parts, begin.tolist()))])
        return Units(joined("counts"), [f for p in parts for f in p.forms], joined("ok"), at, joined("codes"), joined("times"))


class Aligner(dict):
    """Maps a unit to its place in ``known``, or behind it in ``fresh``."""

    def __init__(self, a_model: bytes, b_model: bytes):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_model.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet, size = byte_alphabet(), self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_form, self.b_form = ([str(i).encode() for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))
        described = json.loads(a_model)
        before, merges = described["pre_tokenizer"] or {}, [m if isinstance(m, str) else " ".join(m) for m in described["model"]["merges"]]
        by_regex = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuts = by_regex and not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        # Where ids rise in the order of the merges, merging by rank is the same
        # and a faster library does it.
        own = {m.replace(" ", "") for m in merges}
        ids = [self.a.token_to_id(m.replace(" ", "")) for m in merges]
        self.fast = None
        if by_regex and described["normalizer"] is None and ids == sorted(set(ids)):
            import tiktoken

            ranks = {self.a_bytes[i]: i for i, e in enumerate(entries) if e in own or len(e) == 1 and e in alphabet}
            self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.known, self.fresh = Units.none(), []

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self.known.forms) + len(self.fresh)
        self.fresh.append(unit)
        return at

    def cut(self, text: str) -> list[str]:
        """Units of a text with a space before it."""
        if not self.cuts:
            return [text]
        units = _UNIT.findall(text)
        if sum(map(len, units)) == len(text):
            return units
        at = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])]

    def encoded(self, units: list[str]) -> Units:
        """Units in their order; those that can stand next to others are
        encoded together."""
        parts, held, size = [Units.none()], [], 0
        for unit in [*units, None]:
            alone = unit is None or len(unit) >= LONG_UNIT or unit[-1].isspace()
            if held and (alone or size > JOINED):
                parts.append(self._joined(held))
                held, size = [], 0
            if unit is not None:
                if alone:
                    parts.append(self._joined([unit]))
                else:
                    held.append(unit)
                    size += len(unit)
        return Units.of(parts)

    def _joined(self, units: list[str]) -> Units:
        text = "".join(units)
        raw = text.encode()
        a = self.fast.encode_ordinary(text) if self.fast and (len(units) > 1 or len(text) < LONG_UNIT) else self.a.encode(text, add_special_tokens=False).ids
        a = np.array(a, np.int64)
        # B adds the space itself; before a line feed it is a token apart.
        b = np.array(self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:], np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist()))
        if not same:
            if len(units) == 1:
                return Units.none(1)
            half = len(units) // 2
            return Units.of([self._joined(units[:half]), self._joined(units[half:])])
        unit_end = np.array(list(accumulate(map(len, units)))) if len(raw) == len(text) else np.cumsum([len(u.encode()) for u in units])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        of_a, of_b, unit = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end), np.searchsorted(unit_end, cuts)
        n, g = len(units), len(cuts)
        in_a, in_b = np.bincount(of_a, minlength=g), np.bincount(of_b, minlength=g)
        counts = np.zeros((n, 4), np.int64)
        for k, x in enumerate((in_a, in_b, np.ones(g, np.int64), in_a * in_b)):
            np.add.at(counts[:, k], unit, x)
        unit, codes, times = self._linked(a, b, of_a, in_a, in_b, unit)
        return Units(counts, self._forms(a, b, in_a, in_b, counts[:, 2]), np.ones(n, bool), _offsets(np.bincount(unit, minlength=n)), codes, times)

    def _linked(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, unit: np.ndarray) -> tuple:
        """Distinct (unit, pair) with their numbers of links."""
        from_a, from_b, big = _offsets(in_a), _offsets(in_b), in_a * in_b > BIG_GROUP
        per = np.where(big, 0, in_b)[of_a]
        left = np.repeat(np.arange(len(a)), per)
        right = from_b[of_a[left]] + np.arange(len(left)) - np.repeat(_offsets(per)[:-1], per)
        keys, times = [unit[of_a[left]] << 32 | a[left] << 16 | b[right]], [np.ones(len(left), np.int64)]
        for x in np.nonzero(big)[0].tolist():
            ia, ca = np.unique(a[from_a[x] : from_a[x + 1]], return_counts=True)
            ib, cb = np.unique(b[from_b[x] : from_b[x + 1]], return_counts=True)
            keys.append((unit[x] << 32 | ia[:, None] << 16 | ib[None, :]).ravel())
            times.append((ca[:, None] * cb[None, :]).ravel())
        key, total = _summed(np.concatenate(keys), np.concatenate(times))
        return key >> 32, key & 0xFFFFFFFF, total

    def _forms(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
        left, right = [self.a_form[i] for i in a.tolist()], [self.b_form[i] for i in b.tolist()]
        x = y = 0
        shown = []
        for i, j in zip(in_a.tolist(), in_b.tolist(), strict=True):
            shown.append((left[x] if i == 1 else b",".join(left[x : x + i])) + b"|" + (right[y] if j == 1 else b",".join(right[y : y + j])))
            x += i
            y += j
        ends = np.cumsum(groups).tolist()
        return [b";".join(shown[s:e]) for s, e in zip([0, *ends], ends)]

    def documents(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(counts and digest of each text; places, pairs and links of the
        postings, by place and pair)."""
        places = [[self[u] for u in self.cut(" " + t)] if t else [] for t in texts]
        base = len(self.known.forms)
        every = Units.of([self.known, self.encoded(self.fresh)])
        odd = [k for k, at in enumerate(places) if at and not every.ok[at].all()]  # judged as a whole
        if odd:
            n, whole = len(every.forms), self.encoded([" " + texts[k] for k in odd])
            for i, k in enumerate(odd):
                places[k] = [n + i] if whole.ok[i] else []
            every = Units.of([every, whole])
        if base >= CACHE_UNITS and 2 * len(self.fresh) > base:  # other texts than before
            self.clear()
            self.known = Units.none()
        elif base < CACHE_UNITS:
            n = base + len(self.fresh)
            self.known = Units(every.counts[:n], every.forms[:n], every.ok[:n], every.at[: n + 1], every.codes[: every.at[n]], every.times[: every.at[n]])
        else:
            for u in self.fresh:
                del self[u]
        self.fresh = []
        rows = []
        for at in places:
            n_a, n_b, n_groups, n_links = every.counts[at].sum(axis=0).tolist() if at else (0, 0, 0, 0)
            rows.append((n_a, n_b, n_groups, n_links, hashlib.sha256(b";".join([every.forms[i] for i in at])).hexdigest() if at else ""))
        unit = np.array([i for at in places for i in at], np.int64)
        doc = np.repeat(np.arange(len(places)), [len(at) for at in places])
        key, times = _summed(doc << 32 | unit, np.ones(len(unit), np.int64))
        doc, unit = key >> 32, key & 0xFFFFFFFF
        per = every.at[unit + 1] - every.at[unit]
        pos = np.repeat(every.at[unit] - _offsets(per)[:-1], per) + np.arange(per.sum())
        key, links = _summed(np.repeat(doc, per) << 32 | every.codes[pos], np.repeat(times, per) * every.times[pos])
        return rows, key >> 32, key & 0xFFFFFFFF, links


class Planes:
    """Bit planes of a run. Plane k holds, per pair, the places where bit k of
    the number of links is set: as a list (``lists[k]``: pairs, lengths, places)
    or, where that takes more room, as a bitmap (``maps[k]``: pairs, bits)."""

    def __init__(self, n_docs: int, pairs: np.ndarray, lists: list[tuple], maps: list[tuple]):
        self.n_docs, self.pairs, self.lists, self.maps = n_docs, pairs, lists, maps

    @staticmethod
    def of(n_docs: int, place: np.ndarray, pair: np.ndarray, links: np.ndarray) -> Planes:
        order = np.argsort(pair << 16 | place)  # places lie below 2^16
        place, pair, links = place[order], pair[order], links[order]
        new = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.zeros(0, bool)
        pairs, row = pair[new], np.cumsum(new) - 1
        lists, maps = [], []
        for k in range(int(links.max(initial=0)).bit_length()):
            on = np.nonzero(links >> k & 1)[0]
            count = np.bincount(row[on], minlength=len(pairs))
            dense = count * PLACE_BITS > n_docs
            thin, thick = on[~dense[row[on]]], on[dense[row[on]]]
            rows = np.nonzero(count * ~dense)[0]
            lists.append((rows.astype(np.uint32), count[rows].astype(np.uint16), place[thin].astype(np.uint16)))
            rows = np.nonzero(dense)[0]
            bits = np.zeros((len(rows), -(-n_docs // 8)), np.uint8)
            np.bitwise_or.at(bits, (np.searchsorted(rows, row[thick]), place[thick] >> 3), (1 << (place[thick] & 7)).astype(np.uint8))
            maps.append((rows.astype(np.uint32), bits))
        return Planes(n_docs, pairs, lists, maps)

    def doc_counts(self) -> np.ndarray:
        """Documents of each pair: its planes OR-ed and counted."""
        out, mapped = np.zeros(len(self.pairs), np.int64), np.zeros(len(self.pairs), bool)
        for rows, _ in self.maps:
            mapped[rows] = True
        at = np.cumsum(mapped) - 1
        merged = np.zeros((int(mapped.sum()), -(-self.n_docs // 8)), np.uint8)
        for rows, bits in self.maps:
            merged[at[rows]] |= bits
        rest = []
        for rows, counts, place in self.lists:
            row, place = np.repeat(rows, counts).astype(np.int64), place.astype(np.int64)
            beside = mapped[row]
            np.bitwise_or.at(merged, (at[row[beside]], place[beside] >> 3), (1 << (place[beside] & 7)).astype(np.uint8))
            rest.append(row[~beside] << 16 | place[~beside])
        if rest:
            np.add.at(out, np.unique(np.concatenate(rest)) >> 16, 1)
        out[mapped] = np.bitwise_count(merged).sum(axis=1, dtype=np.int64)
        return out

    def link_counts(self) -> np.ndarray:
        """Links of each pair: popcounts by the weight of the plane."""
        out = np.zeros(len(self.pairs), np.int64)
        for k, ((thin, counts, _), (rows, bits)) in enumerate(zip(self.lists, self.maps, strict=True)):
            out[thin] += counts.astype(np.int64) << k
            out[rows] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64) << k
        return out

    def returned(self, scores: np.ndarray) -> np.ndarray:
        """Per document, the sum over its links of their pair's scores
        (``scores``: a column per kind of score)."""
        out = np.zeros((self.n_docs, scores.shape[1]), np.int64)
        for k, ((thin, counts, place), (rows, bits)) in enumerate(zip(self.lists, self.maps, strict=True)):
            parts = [(np.repeat(thin, counts), place)]
            for s in range(0, len(rows), 1024):
                line, at = np.nonzero(np.unpackbits(bits[s : s + 1024], axis=1, bitorder="little"))
                parts.append((rows[s + line], at))
            for r, p in parts:
                for c in range(scores.shape[1]):
                    np.add.at(out[:, c], p, scores[r, c] << k)
        return out

    def packed(self) -> list[dict]:
        return [dict(zip(PLANE_COLUMNS, (x.tobytes() for x in (*thin, *thick)), strict=True)) for thin, thick in zip(self.lists, self.maps, strict=True)]

    @staticmethod
    def unpacked(n_docs: int, pairs: np.ndarray, planes: list[dict]) -> Planes:
        lists = [tuple(np.frombuffer(x[c], t) for c, t in (("thin", np.uint32), ("counts", np.uint16), ("places", np.uint16))) for x in planes]
        maps = [(rows := np.frombuffer(x["rows"], np.uint32), np.frombuffer(x["bits"], np.uint8).reshape(len(rows), -(-n_docs // 8))) for x in planes]
        return Planes(n_docs, pairs, lists, maps)


PLANE_COLUMNS = ["thin", "counts", "places", "rows", "bits"]
DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
PLANE = [(c, pa.binary()) for c in PLANE_COLUMNS]
RUN = pa.schema([("run", pa.int64()), ("docs", pa.list_(pa.struct(DOC))), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())), ("planes", pa.list_(pa.struct(PLANE)))])
RUN_DDL = (
    "run long, docs array<struct<doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string>>, pairs array<long>, n_docs array<long>, links array<long>, "
    "planes array<struct<thin binary, counts binary, places binary, rows binary, bits binary>>"
)


def runs(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per run: its documents, its pairs (id of A times 2^16 plus id of
    B) with document and link counts, and their planes."""
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        models = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(hashlib.sha256(m).digest() for m in models.value)
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Aligner(*models.value)
        aligner, number = _MODELS[key], TaskContext.get().partitionId() << 32
        rows, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held, size, number
            planes = Planes.of(len(rows), *(np.concatenate([h[c] for h in held]) for c in range(3)))
            row = {
                "run": number, "docs": [dict(zip([n for n, _ in DOC], r, strict=True)) for r in rows], "pairs": planes.pairs,
                "n_docs": planes.doc_counts(), "links": planes.link_counts(), "planes": planes.packed(),
            }
            number += 1
            rows, held, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in RUN], schema=RUN)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(ids):
                end, chars = at, 0
                while end < len(ids) and (end == at or chars + len(texts[end] or "") <= TEXT_AT_ONCE) and len(rows) + end - at < RUN_DOCS:
                    chars += len(texts[end] or "")
                    end += 1
                done, place, pair, links = aligner.documents([t or "" for t in texts[at:end]])
                held.append((place + len(rows), pair, links))
                rows += [(i, *r) for i, r in zip(ids[at:end], done, strict=True)]
                size += len(place)
                at = end
                if size >= RUN_POSTINGS or len(rows) >= RUN_DOCS:
                    yield flush()
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(over, RUN_DDL)


def pair_table(found: DataFrame) -> DataFrame:
    """pair, id_a, id_b, n_docs, n_links and whether n_docs is the highest of
    its A id, from ``runs``."""
    each = found.select(F.explode(F.arrays_zip("pairs", "n_docs", "links")).alias("p")).select("p.pairs", "p.n_docs", "p.links")
    total = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("n_docs"), F.sum("links").alias("n_links")))
    total = total.withColumn("id_a", F.shiftright("pair", 16).cast("int")).withColumn("id_b", F.col("pair").bitwiseAND(0xFFFF).cast("int"))
    highest = F.broadcast(total.groupBy("id_a").agg(F.max("n_docs").alias("_most")))  # at most a row per entry of A
    return total.join(highest, "id_a").select("pair", "id_a", "id_b", "n_docs", "n_links", (F.col("n_docs") == F.col("_most")).alias("is_best"))


RESULT = [*DOC, ("n_best", pa.int64()), ("count_sum", pa.int64())]


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum
    of every row."""
    found = written(runs(docs, a_file, b_file))
    scores = pair_table(found).select("pair", "n_docs", F.col("is_best").cast("long").alias("best"))
    wanted = found.select("run", F.explode("pairs").alias("pair"))
    scored = wanted.join(scores, "pair").select("run", "pair", "n_docs", "best")
    held = found.select("run", F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n_docs"), F.lit(None).cast("long").alias("best"), "docs", "pairs", "planes")
    both = scored.unionByName(held, allowMissingColumns=True).withColumn("last", F.col("pair").isNull())

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            begin = 0
            for at in np.nonzero(batch.column("last").to_numpy(zero_copy_only=False))[0].tolist() + [batch.num_rows]:
                some = batch.slice(begin, at - begin)
                if some.num_rows:
                    parts.append(np.stack([some.column(c).to_numpy(zero_copy_only=False) for c in ("n_docs", "best")], axis=1).astype(np.int64))
                begin = at + 1
                if at == batch.num_rows:
                    continue
                row = {c: batch.column(c)[at].as_py() for c in ("docs", "planes")}
                pairs = batch.column("pairs")[at].values.to_numpy()
                score = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
                parts = []
                sums = Planes.unpacked(len(row["docs"]), pairs, row["planes"]).returned(score)
                cols = [[d[n] for d in row["docs"]] for n, _ in DOC] + [sums[:, 1], sums[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, RESULT, strict=True)], [n for n, _ in RESULT])

    # A run's scores come in the order of its pairs, then the run itself.
    ordered = both.repartition("run").sortWithinPartitions("run", "last", "pair")
    return ordered.select("n_docs", "best", "docs", "pairs", "planes", "last").mapInArrow(back, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
