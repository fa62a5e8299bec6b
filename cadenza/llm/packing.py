"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its tokenizer ids followed by an end id. Only documents longer than a sequence are cut,
into pieces of the full length with a shorter last one. Pieces are dealt by hash into groups of about
GROUP pieces; each group is packed apart, by bounded-space online best fit: pieces are taken as they
come (in the order of a hash), each placed for good before the next is seen. At most OPEN bins are open, kept
in a bitset by free space (bit f is set while some open bin has f free), so the tightest bin that takes a
piece is the lowest bit from its length up. A bin that is full closes; when another must open and OPEN
are open, the fullest closes first. What is lost is the free space of the bins closed early and, at
the end of a group, of those still open.

Repeated rows go to groups by their number within a batch as well, so a row that makes up a third of a
table is spread over all groups.

Tokens: ids are made per word (text between spaces, tabs and line ends), each distinct word once,
and laid end to end; the tokenizer splits at white space first, so this equals encoding the whole
text. Words are told apart by a 64-bit hash. The words seen are kept between a task's batches, up to
WORDS of them; then they are forgotten.

Defined results: null text is empty, and an empty document is its end id alone. Repeated rows are
packed as separate documents. An empty table gives an empty result. Reruns put pieces into equal
sequences. Columns beside doc_id and text don't take part.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import hashing
from cadenza.llm.common import staged, table, tidied

LENGTH = 2048
OPEN = 128
GROUP = 16384
END = 0
WORDS = 500_000
JOINED = 200

#: Words end at these bytes alone, and before a full stop or comma that follows a letter or digit and ends them.
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 32]] = True
_POINT = (np.isin(np.arange(256), list(b",.")), np.array([chr(i).isalnum() and i < 128 for i in range(256)]))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words:
    """Ids of texts by way of their words, looked up by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = next(t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special).content
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.opening = np.zeros(256, bool)  # first bytes of added tokens, which are matched in the text as it stands
        self.opening[[t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # ascending, with each word's code
        self.codes = np.zeros(0, np.int64)
        self.pool, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has. A special token between words tells them apart."""
        runs = [self.mark.join([*words[i : i + JOINED], ""]) for i in range(0, len(words), JOINED)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], "<u4")
        marks = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        odd = [i for i, w in enumerate(words) if self.mark in w]
        ids, lengths = self._encode([w if self.mark not in w else "" for w in words])
        if odd:
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, "<u4")
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.codes = np.insert(self.codes, at, np.arange(len(self.lengths), len(self.lengths) + len(words)))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of each text that lies in `data` from one bound to the next."""
        size = np.diff(bounds)
        if self.folds:  # lower case or not gives equal ids, but for added tokens; fewer words differ
            odd = np.diff(np.concatenate([[0], np.cumsum((data >= 128) | self.opening[data])])[bounds])
            data = np.where(np.repeat(odd == 0, size), hashing.LOWER[data], data)
        starts, stops, count = hashing.words(data, bounds, _SEPARATES, _POINT)
        found, first, code = np.unique(hashing.hashes(data, starts, stops), return_index=True, return_inverse=True)
        new = ~self._known(found)
        if new.any():
            if len(self.hashes) + int(new.sum()) > WORDS:
                self.forget()
                new[:] = True
            view = memoryview(data)
            words = [str(view[a:b], "utf-8") for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)]
            self._learn(found[new], words)
        code = self.codes[np.searchsorted(self.hashes, found)][code]
        lengths = self.lengths[code]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.starts[code] - ends + lengths, lengths) + np.arange(int(lengths.sum()))]
        cuts = np.concatenate([[0], ends])[np.cumsum(count)]
        return np.split(ids, cuts[:-1])


def _encoder(path: str) -> _Words:
    """One for each worker process and vocabulary."""
    import sys

    kept = sys.modules.setdefault("_cadenza_words", type(sys)("_cadenza_words")).__dict__
    if path not in kept:
        kept[path] = _Words(path)
    return kept[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, nth[, ids]): a row for each piece; nth numbers a batch's equal pieces of equal documents."""

    def numbered(doc_ids: pa.Array, piece: tuple, crc: tuple) -> pa.Array:
        rows = pd.DataFrame({"d": doc_ids.to_pandas(), "p": piece, "c": crc})
        return pa.array(rows.groupby(["d", "p", "c"], dropna=False).cumcount().to_numpy(), pa.int64())

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            out = []
            data, offsets = hashing.buffers(batch["text"])
            for first, last in hashing.pieces(offsets, 1 << 19):
                part = encoder.ids(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                for i, ids in enumerate(part, first):
                    ids = np.append(ids, np.array(END, "<u4"))
                    for k, at in enumerate(range(0, len(ids), length)):
                        piece = ids[at : at + length]
                        out.append((i, k, at, len(piece), zlib.crc32(piece.tobytes()), piece.astype(np.int32) if with_ids else None))
            rows, *columns, ids = zip(*out, strict=True) if out else [()] * 6
            arrays = [batch["doc_id"].take(pa.array(rows, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            arrays.append(numbered(arrays[0], columns[0], columns[3]) if out else pa.array([], pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        encoder.forget()  # an idle worker holds no words

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def best_fit(lengths: list[int], capacity: int, most_open: int) -> tuple[list[int], list[int], int]:
    """The bin and the place in it of each piece, taken in the order given, and how many bins closed before they were full."""
    by_free: dict[int, list[int]] = {}
    bits = n_open = n_bins = early = 0
    bins, places = [], []
    for size in lengths:
        if fitting := bits >> size:
            free = size + (fitting & -fitting).bit_length() - 1
            into = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if n_open == most_open:
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
                early += 1
            into, free = n_bins, capacity
            n_bins += 1
            n_open += 1
        bins.append(into)
        places.append(capacity - free)
        if left := free - size:
            by_free.setdefault(left, []).append(into)
            bits |= 1 << left
        else:
            n_open -= 1
    return bins, places, early


def pack(rows: DataFrame, length: int = LENGTH, most_open: int = OPEN, group: int = GROUP) -> DataFrame:
    """`rows` of pieces with sequence_id and offset. They are written once, as their number sets the groups."""
    rows = staged(rows)
    groups = max(1, -(-rows.count() // group))
    dealt = F.xxhash64("doc_id", "piece", "ids_crc32", "length", "nth")
    keyed = rows.select("*", F.pmod(dealt, F.lit(groups)).alias("grp"), dealt.alias("place")).drop("nth")

    def run(one: pa.Table) -> pa.Table:
        one = one.sort_by([(c, "ascending") for c in ("place", "doc_id", "piece", "ids_crc32")])
        bins, places, _ = best_fit(one["length"].to_pylist(), length, most_open)
        base = (one["grp"][0].as_py() << 32) if len(one) else 0
        ids = pa.array(np.asarray(bins, np.int64) + base, pa.int64())
        return one.drop_columns(["grp", "place"]).append_column("sequence_id", ids).append_column("offset", pa.array(places, pa.int64()))

    schema = rows.drop("nth").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return keyed.groupBy("grp").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path or vocabulary(), length, with_ids), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
