"""Language by cross-parsing entropy: a text is parsed greedily into the longest phrases that occur in a language's labelled
text; the language that needs the fewest phrases for the text's length wins.

A suffix automaton of at most sample_bytes of each language's labelled text (whole documents, those first by a hash of their id
that fit; only of a language without any that fits, the beginning of one) gives the matches. sample_bytes is the bound on
training; with many languages it shrinks so that all tables together stay within table_bytes in a worker. An automaton becomes
a table of transitions over bytes, in which a missing one starts a new phrase from the root.

Texts are parsed whole. Stretches of `stretch` bytes are parsed side by side, each as if a phrase began there; then the phrase
that really was open at a stretch's start is followed until both parses begin a phrase at one place, from where they agree. Where
they never do within a stretch, that text is parsed again in one go. So the phrases are those of one parse from the beginning.

Texts are lower-cased and runs of other than letters and marks become one space. Null texts and texts without a letter get
`und` and score 0; so do all if nothing was learned. Ties go to the first language by name. Null languages aren't learned
from, nor, in the query, are rows with a null id, whose held_out is false. Repeated rows get equal results, columns named as
results are replaced, an empty table gives an empty result. Scoring is map-only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import fold, slices, table

SAMPLE_BYTES, STRETCH, TABLE_BYTES = 60_000, 512, 256 << 20


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the states; state 0 is the root, every path from it spells a substring of data."""
    trans, link, length, last = [{}], [-1], [0], 0
    for c in data:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


@lru_cache(maxsize=4096)  # their bytes are bounded by TABLE_BYTES
def parse_table(data: bytes, class_bytes: bytes, n_classes: int) -> np.ndarray:
    """table[state * n_classes + class of the byte]: twice the next state, plus 1 if a new phrase starts there. Kept between tasks of a worker."""
    classes = np.frombuffer(class_bytes, np.uint8)
    trans = suffix_automaton(data)
    out = np.full((len(trans) + 1, n_classes), -1, np.int32)  # the last: after a byte that the data lacks, a phrase of its own
    for s, row in enumerate(trans):
        for c, to in row.items():
            out[s, classes[c]] = to
    root = np.where(out[0] < 0, len(trans), out[0])
    missing = out < 0
    out = np.where(missing, root[None, :], out) * 2 + missing
    return out.astype(np.int32).ravel()


def phrases(data: bytes, text: bytes) -> int:
    """Phrases of one text, for tests: the plain greedy parse."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in data:
            k += 1
        n, i = n + 1, i + k
    return n


def _normal(text):
    return F.when(text.rlike(r"\p{L}"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")).otherwise(F.when(text.isNotNull(), F.lit("")))


def learn_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, table_bytes: int = TABLE_BYTES) -> dict[str, bytes]:
    """At most sample_bytes of normalised text per language. Each task keeps no more than that per language, so little moves."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best: dict[str, list] = {}
        for batch in batches:
            for part in slices(batch, 1024):
                for key, order, t in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    have = best.setdefault(key, [])
                    have.append((order, t if len(t) <= sample_bytes else t[:sample_bytes], len(t) > sample_bytes))
                    if len(have) > 400:
                        best[key] = _first(have, sample_bytes)
        rows = [(k, *r) for k, v in best.items() for r in _first(v, sample_bytes)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.bool_())], names=["lang", "o", "t", "part"])

    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    few = usable.select(F.col(lang).alias("lang"), F.xxhash64("doc_id").alias("o"), _normal(F.col(text)).cast("binary").alias("t")).where(F.length("t") > 0).mapInArrow(cut, "lang string, o long, t binary, part boolean")

    def merge(key, pdf):
        rows = _first(list(zip(pdf["o"], pdf["t"], pdf["part"], strict=True)), sample_bytes)
        return pdf.head(1)[["lang"]].assign(t=b" ".join(r[1] for r in rows))

    found = {r["lang"]: bytes(r["t"]) for r in few.groupBy("lang").applyInPandas(merge, "lang string, t binary").collect()}  # at most sample_bytes a language
    found = {k: t for k, t in sorted(found.items()) if t.strip()}
    # A state takes four bytes for each class of bytes; an automaton has at most two states a byte.
    classes = len(set(b"".join(found.values()))) + 1
    fits = table_bytes // max(1, len(found) * classes * 8)
    return {k: t[: max(64, fits)] for k, t in found.items()}


def _first(rows: list, size: int) -> list:
    """Whole rows (order, text, whether cut) in order as far as they fit; if there are cut ones only, the first."""
    out, n = [], 0
    for r in sorted(r for r in rows if not r[2]):
        if n + len(r[1]) <= size:
            out.append(r)
            n += len(r[1]) + 1
    return out or sorted(rows)[:1]


def count_phrases(texts: list[bytes], tables: list[np.ndarray], classes: np.ndarray, n_classes: int, stretch: int = STRETCH) -> np.ndarray:
    """(tables, texts) numbers of phrases of each whole text; 0 for empty ones."""
    pieces = [(i, a, min(stretch, len(t) - a)) for i, t in enumerate(texts) for a in range(0, len(t), stretch)]
    counts = np.zeros((len(tables), len(texts)), np.int64)
    if not pieces:
        return counts
    row, offset, size = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    begin = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    flat = classes[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32)
    order = np.argsort(-size, kind="stable")
    start, lens = (begin[row] + offset)[order], size[order]
    longer = np.searchsorted(-lens, -np.arange(int(lens[0])), "left").tolist()  # how many pieces are longer than k
    place = np.empty(len(pieces), np.int64)
    place[order] = np.arange(len(pieces))
    last = np.append(row[1:] != row[:-1], True)
    follows = np.flatnonzero(offset > 0)  # pieces that go on from the one before
    for j, move in enumerate(tables):
        state = np.zeros(len(pieces), np.int32)
        breaks = np.zeros((int(lens[0]), len(pieces)), bool)  # where the parses of the pieces begin a phrase
        for k in range(int(lens[0])):
            m = longer[k]
            step = move[state[:m] * n_classes + flat[start[:m] + k]]
            state[:m] = step >> 1
            breaks[k, :m] = step & 1 if k else 1
        own = breaks.sum(0, dtype=np.int64)[place]
        # Follow the open phrase into each piece until both parses begin one at a place: own breaks before it go, true ones come.
        live = follows[np.argsort(-size[follows], kind="stable")]
        now, true, gone = state[place[live - 1]], np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        column, first, length = place[live], start[place[live]], size[live]
        at, k = np.arange(len(live)), 0
        lost: set[int] = set()
        while len(at):
            over = length[at] <= k
            if over.any():
                ended = live[at[over]]  # a text's last piece was followed to its end; another's successor began from a wrong state
                lost.update(row[ended[~last[ended]]].tolist())
                at = at[~over]
                if not len(at):
                    break
            step = move[now[at] * n_classes + flat[first[at] + k]]
            now[at] = step >> 1
            begun, theirs = (step & 1).astype(bool), breaks[k, column[at]]
            met = begun & theirs
            true[at] += begun & ~met
            gone[at] += theirs & ~met
            at, k = at[~met], k + 1
        own[live] += true - gone
        counts[j] = np.bincount(row, own, len(texts)).astype(np.int64)
        for i in lost:
            counts[j, i] = _phrases_of(flat[begin[i] : begin[i] + len(texts[i])].tolist(), move, n_classes)
    return counts


def _phrases_of(codes: list[int], move: np.ndarray, n_classes: int) -> int:
    state, n = 0, 0
    for k, c in enumerate(codes):
        step = int(move[state * n_classes + c])
        state, n = step >> 1, n + (step & 1 if k else 1)
    return n


def predict_languages(docs: DataFrame, samples: dict[str, bytes], text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """docs without text, with lang_pred and score: the runner-up's share of the phrases of the best two, 0.5..1."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", text)]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    langs = list(samples)
    classes = np.zeros(256, np.uint8)
    seen = sorted(set(b"".join(samples.values())))
    classes[seen] = np.arange(1, len(seen) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most sample_bytes a language

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n_classes = len(seen) + 1
        tables = {k: parse_table(v, classes.tobytes(), n_classes) for k, v in shared.value.items()}
        for batch in batches:
            for part in slices(batch, 1024):
                texts = [t or b"" for t in part.column(len(names)).to_pylist()]
                texts = [b"" if not t.strip() else t for t in texts]
                sizes = np.array([len(t) for t in texts], np.int64)
                counts = count_phrases(texts, [tables[k] for k in langs], classes, n_classes, stretch)
                best = ["und"] * len(texts)
                score = np.zeros(len(texts))
                if langs:
                    order = np.argsort(counts, 0, "stable")
                    at = np.arange(len(texts))
                    first, second = counts[order[0], at], counts[order[min(1, len(langs) - 1)], at]
                    has = sizes > 0
                    score = np.where(has, second / np.maximum(first + second, 1), 0.0)
                    best = [langs[k] if ok else "und" for k, ok in zip(order[0], has, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(best, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.select(*names, _normal(F.col(text)).cast("binary").alias("__t")).mapInArrow(predict, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn_languages(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    return predict_languages(docs.select("doc_id", "text"), samples).select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
