"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1. An n-gram's vector binds its letters'
vectors, each permuted (rolled) by its place, by multiplication. A document's
vector bundles (adds) the vectors of all trigrams of its text, word edges included; a
language's prototype bundles its documents. Documents are compared with
prototypes by cosine.

Bundling is linear: each task sums one vector for each language, and what the
driver holds is languages x dimensions, whatever the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from corpuslake.llm.lean import lean

DIM = 1024
#: Places of letters in the table: code points below 1024 as they are, the rest folded.
_LETTERS = 2048
#: Characters of texts that are bundled at once, the least that a text counts for, and trigrams multiplied at once.
SLICE, LEAST, CODES = 1 << 19, 256, 2048
UND = "und"


def _letter_table() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> letter number (0: no letter, as a word edge), and the letters' vectors."""
    import sys
    import unicodedata

    table = np.zeros(sys.maxunicode + 1, np.int16)
    for cp in range(sys.maxunicode + 1):
        if unicodedata.category(chr(cp))[0] == "L":
            low = ord(chr(cp).lower()[0])
            table[cp] = low if low < 1024 else 1024 + low * 2654435761 % 2**32 % 1024
    vectors = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (_LETTERS, DIM))
    return table, vectors


_tables: list = []


def _tables_once():
    """The letter table, and the letters' vectors for the first, second and last place of a trigram."""
    if not _tables:
        table, v = _letter_table()
        _tables.extend((table, np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v))
    return _tables


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the trigrams of each text: (text number, trigram code, count), sorted, and letters in each text."""
    table = _tables_once()[0]
    joined = "".join(f"\n{t}\n" for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = table[cps].astype(np.int64)
    ends = np.cumsum([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    letters = np.bincount(owner[c > 0], minlength=len(texts))
    # one edge between words: drop an edge that follows an edge
    stay = np.ones(len(c), bool)
    stay[1:] = (c[1:] > 0) | (c[:-1] > 0) | (owner[1:] != owner[:-1])
    c, owner = c[stay], owner[stay]
    if len(c) < 3:
        return *(np.zeros(0, np.int64),) * 3, letters
    code = (c[:-2] << 22) | (c[1:-1] << 11) | c[2:]
    ok = (owner[:-2] == owner[2:]) & (c[1:-1] > 0)
    key = np.sort((owner[:-2][ok] << 33) | code[ok])
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at] >> 33, key[at] & (2**33 - 1), np.diff(np.append(at, len(key))), letters


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """The bound vector of each trigram code."""
    _, first, second, last = _tables_once()
    out = first[codes >> 22]
    out *= second[(codes >> 11) & 2047]
    out *= last[codes & 2047]
    return out


def _parts(texts: list[str | None]):
    """Texts in groups of about SLICE characters: [(row, text)]; a longer text comes in parts, cut between words where it has any."""
    group, size = [], 0
    for row, t in enumerate(texts):
        t = t or ""
        at = 0
        while True:
            end = at + SLICE
            if end < len(t):
                end = max(t.rfind(" ", at + 1, end), t.rfind("\n", at + 1, end))
                end = at + SLICE if end <= at else end
            group.append((row, t[at:end]))
            size += max(LEAST, min(len(t), end) - at)
            at = end
            if size >= SLICE:
                yield group
                group, size = [], 0
            if at >= len(t):
                break
    if group:
        yield group


def _bundles(texts: list[str | None]):
    """(rows, vectors, letters) of groups of texts; a row may come in several groups."""
    for group in _parts(texts):
        number, code, count, letters = ngrams([t for _, t in group])
        order = np.argsort(code, kind="stable")
        number, code, count = number[order], code[order], count[order]
        new = np.diff(code, prepend=-1) != 0
        codes, column = code[new], np.cumsum(new) - 1
        # sums of +-1 up to SLICE are exact in float32
        vectors = np.zeros((len(group), DIM), np.float32)
        for lo in range(0, len(codes), CODES):
            a, z = np.searchsorted(column, [lo, lo + CODES])
            counts = np.zeros((len(group), min(CODES, len(codes) - lo)), np.float32)
            counts[number[a:z], column[a:z] - lo] = count[a:z]
            vectors += counts @ vectors_of(codes[lo : lo + CODES])
        yield np.array([r for r, _ in group]), vectors, letters


def learn(labelled: DataFrame, most_rows: int = 50_000) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from labelled (text, lang) rows; null texts and langs teach nothing.

    At most about ``most_rows`` rows teach: of more, those whose text has a low
    hash, so the choice does not depend on how the rows are stored. Rows of
    equal text are taken or left together.
    """
    rows = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(most_rows / n * (1 << 30)))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for row, vectors, _ in _bundles(texts):
                for r, v in zip(row.tolist(), vectors):
                    sums.setdefault(langs[r], np.zeros(DIM))[:] += v
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.rint(v).astype(np.int64))], names=["lang", "i", "v"])

    found: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(lean(run), "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.lang, np.zeros(DIM))[r.i] = r.v
    langs = sorted(found)
    if not langs:
        return [], np.zeros((0, DIM))
    p = np.stack([found[x] for x in langs])
    return langs, p / np.maximum(np.linalg.norm(p, axis=1), 1e-12)[:, None]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred and score (cosine with the nearest prototype, not below 0).

    Only ``text`` is looked at, all of it. Null texts, texts without a letter and
    models without languages give ``und`` and 0. Ties go to the first language in
    order. Other columns come back unchanged, except for those two names.
    """
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x dimensions

    def run(batches):
        langs, prototypes = shared.value
        for b in batches:
            texts = b.column(place).to_pylist()
            dots, squares, letters = np.zeros((len(texts), len(langs))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            long_row, long_sum = -1, np.zeros(DIM)  # a text in several parts is the sum of them
            for row, vectors, count in _bundles(texts):
                v = vectors.astype(np.float64)
                np.add.at(letters, row, count)
                for i in np.flatnonzero(np.isin(row, [r for r in set(row.tolist()) if len(texts[r] or "") > SLICE])).tolist():
                    long_sum = v[i] + (long_sum if row[i] == long_row else 0)
                    long_row, v[i] = row[i], long_sum
                dots[row], squares[row] = v @ prototypes.T, (v * v).sum(axis=1)
            yield _answer(b, langs, dots, squares, letters)

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def _answer(b: pa.RecordBatch, langs: list[str], dots: np.ndarray, squares: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
    cosine = dots / np.sqrt(np.maximum(squares, 1e-12))[:, None]
    best = cosine.argmax(axis=1) if langs else np.zeros(len(letters), np.int64)
    known = (letters > 0) & bool(langs)
    score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0) if langs else np.zeros(len(letters))
    names = [langs[i] if k else UND for i, k in zip(best.tolist(), known.tolist())]
    return pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])
