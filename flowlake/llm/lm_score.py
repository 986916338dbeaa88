"""Language-model scores by deleted interpolation.

A trigram model: p(w | u v) = l3 f(w | u v) + l2 f(w | v) + l1 f(w) + l0 / (V + 1), f being maximum-likelihood estimates over
training tokens and the weights l chosen by bucket of the context's frequency: of u v, or of v where u v wasn't seen.
Expectation-maximisation learns them on held-out counts: a fold of the training documents, predicted from the counts of the
others.

Counting is an exchange of requests: documents form chunks (runs of rows of a file); each chunk sends its distinct n-gram
hashes and counts as packed arrays to the buckets of the key space, which sum them and send the sums back in the order of the
keys; chunks then score their texts. So no table of n-grams is ever held whole by a task or the driver. A chunk is made of
data alone (file and row number, or id and text), so reading may be split otherwise each time; every reply carries a checksum
of its keys, and a mismatch raises. Keys of pairs and triples have sixteen bits more than the corpus' characters need (64 at
most), so the chance that an n-gram shares another's key is a few in a million at every size up to 10^14 characters. The held-out counts come to the driver as a grid of cells a quarter of a decade wide with
their mean estimates, whose size does not depend on the input.

Tokens: words lower-cased in A-Z, then one end per document. Null and blank texts are one end. Null ids are training rows.
Repeated rows count as often as they occur. A text of any length is scored whole, by one task. Columns other than doc_id and
the text aren't carried, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, mix, slices, stored, table, word_hashes

TEST_FOLD, FOLDS, DEV_FOLD = 2, 7, 3
CHUNK_BYTES, BUCKET_CHARS, HELD_KEYS = 4 << 20, 12_000_000, 8_000_000
_END, _START, _TRIPLE = np.uint64(0x1234567089ABCDEF), np.uint64(0x0FEDCBA987654321), np.uint64(0x5BD1E995A5A5F00D)
_ONE = np.uint64(1)
_GRID = 4  # cells a decade
_LOWEST = -99


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram keys, keys of their contexts, and the number of tokens of each text, ends included."""
    h, counts = word_hashes(texts)
    sizes = counts + 1
    stops = np.cumsum(sizes)
    tok = np.full(int(stops[-1]) if len(stops) else 0, _END, np.uint64)
    is_word = np.ones(len(tok), bool)
    is_word[stops - 1] = False
    tok[is_word] = h
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[stops - sizes] = _START
    return tok, before, sizes


def _join(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + tok)


def _triples(pair: np.ndarray, tok: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (two before, one before, token), and which places have one: all but the first of each text."""
    inner = np.ones(len(tok), bool)
    inner[np.cumsum(sizes) - sizes] = False
    return _join(np.roll(pair, 1)[inner] ^ _TRIPLE, tok[inner]), inner


def _count(flagged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (even, sorted) of keys whose lowest bit says whether to count them, and how often they count."""
    flagged = np.sort(flagged)
    keys = flagged & ~_ONE
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[at], np.add.reduceat((flagged & _ONE).astype(np.int64), at) if len(at) else np.empty(0, np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=~keys[:1]) != 0]


def _spread(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each of keys what found, by distinct key in order, says of it."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), found.dtype)
    out[order] = found[np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)] if len(keys) else found[:0]
    return out


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as the gaps between them, byte by byte, compressed."""
    import pyarrow as pa

    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(4, "little") + pa.compress(gaps.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(data[:4], "little")
    gaps = pa.decompress(data[4:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, with that number first."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"u{data[0]}"), offset=1).astype(np.int64)


def _keys_of(texts: list[bytes | None], width: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys by kind (tokens; starts of documents and pairs; triples), the text that each belongs to, tokens, what precedes them, sizes."""
    tok, before, sizes = _tokens(texts)
    row = np.repeat(np.arange(len(texts)), sizes)
    pair = _join(before, tok)
    triple, inner = _triples(pair, tok, sizes)
    cut, even = np.uint64(64 - width), ~_ONE
    begins = np.full(len(texts), _START)
    return [tok & even, (np.concatenate((begins, pair)) >> cut) & even, (triple >> cut) & even], [row, np.concatenate((np.arange(len(texts)), row)), row[inner]], tok, before, sizes


def _requests(docs: DataFrame, bits: int, width: int) -> DataFrame:
    """chunk, kind, bucket, dev, keys, counts (training counts). A chunk that two tasks read, or that is sent in parts, has several rows a bucket."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list] = {}
        dev_of: dict[int, bool] = {}

        def emit():
            for c, parts in held.items():
                for kind in (0, 1, 2):
                    keys, n = _count(np.concatenate([p[kind] for p in parts]))
                    bucket = _bucket(keys, bits, 64 if kind == 0 else width)
                    cuts = np.flatnonzero(np.diff(bucket)) + 1
                    for k, x, b in zip(np.split(keys, cuts), np.split(n, cuts), np.split(bucket, cuts), strict=True):
                        if len(k):
                            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([kind], pa.int32()), pa.array([int(b[0])], pa.int64()), pa.array([dev_of[c]]), pa.array([_pack(k)], pa.binary()), pa.array([_small(x)], pa.binary())], names=["chunk", "kind", "bucket", "dev", "keys", "counts"])
            held.clear()

        size = 0
        for batch in batches:
            for part in slices(batch, 1024):
                chunks, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
                train = part.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
                dev = part.column(3).to_numpy(zero_copy_only=False)
                keys, rows, *_ = _keys_of(texts, width)
                for c in np.unique(chunks):
                    own = chunks == c
                    dev_of[int(c)] = bool(dev[own].any())
                    held.setdefault(int(c), []).append([k[own[r]] | train[r[own[r]]] for k, r in zip(keys, rows, strict=True)])
                size += sum(len(k) for k in keys)
                if size > HELD_KEYS:
                    yield from emit()
                    size = 0
        yield from emit()

    return docs.select("chunk", F.col("t"), "train", "dev").mapInArrow(run, "chunk long, kind int, bucket long, dev boolean, keys binary, counts binary")


def _bucket(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    return (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _proof(keys: np.ndarray) -> int:
    """A checksum of distinct keys."""
    return int(mix(keys).sum(dtype=np.uint64).astype(np.int64)) if len(keys) else 0


def _answer(key, pdf):
    """The sums of a bucket to each chunk that asked, in the order of its keys, and the bucket's distinct and total training tokens as chunk null."""
    import pandas as pd

    kind, bucket = key
    asked = [_unpack(k) for k in pdf["keys"]]
    counts = [_large(c) for c in pdf["counts"]]
    keys = _distinct(np.concatenate(asked))
    at = np.concatenate([np.searchsorted(keys, k) for k in asked])
    total = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)
    dev = np.bincount(at, np.concatenate([c * bool(d) for c, d in zip(counts, pdf["dev"], strict=True)]), len(keys)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, asked)])
    own: dict[int, tuple] = {}
    for c, d, a, b in zip(pdf["chunk"], pdf["dev"], cuts[:-1], cuts[1:], strict=True):
        own.setdefault(int(c), (d, []))[1].append(at[a:b])
    rows = []
    for c, (d, parts) in own.items():
        spots = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        rows.append((c, kind, bucket, d, _small(total[spots]), _small(dev[spots]), _proof(keys[spots]), None, None, None))
    if kind == 0:
        main = total - dev
        rows.append((None, kind, bucket, None, None, None, None, int((total > 0).sum()), int(total.sum()), int(main.sum())))
    names = ["chunk", "kind", "bucket", "dev", "total", "devs", "proof", "v", "n", "n_main"]
    kinds = ("chunk", "proof", "v", "n", "n_main")  # 64 bits whole, beside nulls
    return pd.DataFrame({c: pd.array([r[k] for r in rows], dtype="Int64") if c in kinds else [r[k] for r in rows] for k, c in enumerate(names)})


def _lookup(texts: list[bytes | None], answers, which: str, bits: int, width: int):
    """Sizes of a chunk's texts, and by token the counts of: the token, its context, the pair, the pair before it, the triple. which: total, or main (without held-out)."""
    keys, _, tok, before, sizes = _keys_of(texts, width)
    got = []
    for kind in (0, 1, 2):
        asked = _distinct(keys[kind])
        own = answers[answers["kind"] == kind].sort_values("bucket")
        bucket = _bucket(asked, bits, 64 if kind == 0 else width)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        if [_proof(k) for k in np.split(asked, cuts) if len(k)] != own["proof"].tolist():
            raise RuntimeError("the texts of a chunk are not those that its counts were asked for")
        parts = [_large(t) - (_large(d) if which == "main" else 0) for t, d in zip(own["total"], own["devs"], strict=True)]
        counts = np.concatenate(parts) if parts else np.empty(0, np.int64)
        got.append(_spread(keys[kind], counts))
    uni, starts, two = got[0], int(got[1][0]) if len(texts) else 0, got[1][len(texts) :]
    first = before == _START
    context = np.where(first, starts, np.roll(uni, 1))
    context2 = np.where(first, starts, np.roll(two, 1))
    three = two.copy()  # a text's first token has the start for a context, however long
    three[~_first_places(sizes, len(tok))] = got[2]
    return sizes, uni, context, two, context2, three


def _first_places(sizes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[np.cumsum(sizes) - sizes] = True
    return out


def _level(context: np.ndarray, context2: np.ndarray) -> np.ndarray:
    """Bucket of the contexts' frequencies (0, 1, 2-3, 4-7, ...): of the pair before a token, or if that wasn't seen, 64 on, of the token before it."""
    log = lambda x: np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))) + 1, 0).astype(np.int64)
    return np.where(context2 > 0, log(context2), 64 + log(context))


def learn_weights(cells: list[tuple[int, float, float, float, int]], uniform: float, levels: int = 128, rounds: int = 60) -> np.ndarray:
    """(levels, 4) weights of triple, pair, token and uniform estimates from (level, the three estimates, count)."""
    weights = np.tile(np.array([0.3, 0.3, 0.3, 0.1]), (levels, 1))
    if cells:
        level = np.array([c[0] for c in cells])
        n = np.array([c[4] for c in cells], float)
        p = np.column_stack((np.array([c[1:4] for c in cells], float), np.full(len(n), uniform)))
        for _ in range(rounds):
            part = weights[level] * p
            part = part / part.sum(1, keepdims=True) * n[:, None]
            sums = np.stack([np.bincount(level, part[:, k], levels) for k in range(4)], 1)
            seen = sums.sum(1) > 0
            weights[seen] = (sums[seen] + 1e-3) / (sums[seen] + 1e-3).sum(1, keepdims=True)
        for half in (range(64), range(64, levels)):  # levels that weren't seen take the nearest below that was
            last = next((k for k in half if seen[k]), None)
            for k in half:
                if last is not None:
                    last = k if seen[k] else last
                    weights[k] = weights[last]
    return weights


def score_corpus(docs: DataFrame, text: str = "text", place: tuple[str, str] | None = None, bits: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. place: columns of a row's file and its number within, by which rows that are read together form a chunk; without it rows are dealt into chunks by id and text, at the cost of a shuffle."""
    chars, count = docs.agg(F.sum(F.length(text)), F.count(F.lit(1))).first()
    chars, count = int(chars or 0), int(count)
    if bits is None:
        bits = (chars // BUCKET_CHARS).bit_length()
    width = min(64, max(bits, chars.bit_length() + 17))
    folded = F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(0))
    dev = folded == DEV_FOLD
    if place:
        per_chunk = max(1, chunk_bytes * count // max(1, chars))
        chunk = F.xxhash64(place[0], F.floor(F.col(place[1]) / per_chunk), dev)
    else:
        chunk = F.xxhash64(F.pmod(F.xxhash64("doc_id", F.col(text)), F.lit(max(1, chars // chunk_bytes))), dev)
    base = docs.select("doc_id", F.col(text).cast("binary").alias("t"), (folded != TEST_FOLD).alias("train"), dev.alias("dev"), chunk.alias("chunk"))
    asking = base if place else base.repartition("chunk")
    answers = stored(_requests(asking, bits, width).groupBy("kind", "bucket").applyInPandas(_answer, "chunk long, kind int, bucket long, dev boolean, total binary, devs binary, proof long, v long, n long, n_main long"))
    v, n, n_main = (int(x or 0) for x in answers.where(F.col("chunk").isNull()).agg(F.sum("v"), F.sum("n"), F.sum("n_main")).first())
    replies = answers.where(F.col("chunk").isNotNull()).select("chunk", "dev", "kind", "bucket", "total", "devs", "proof")

    def estimates(uni, context, two, context2, three, tokens):
        return three / np.maximum(context2, 1), two / np.maximum(context, 1), uni / max(tokens, 1)

    def grid(texts, found):
        import pandas as pd

        cells, sums = ["level", "a", "b", "c"], ["p3", "p2", "p1"]
        if not len(texts):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in [*cells, "n"]} | {c: pd.Series(dtype="float64") for c in sums})
        _, uni, context, two, context2, three = _lookup(list(texts["t"]), found, "main", bits, width)
        p = estimates(uni, context, two, context2, three, n_main)
        cell = lambda x: np.where(x > 0, np.round(np.log10(np.maximum(x, 1e-12)) * _GRID), _LOWEST).astype(np.int64)
        out = pd.DataFrame({"level": _level(context, context2)} | {c: cell(x) for c, x in zip(cells[1:], p, strict=True)} | dict(zip(sums, p, strict=True)) | {"n": 1})
        return out.groupby(cells, as_index=False).sum()

    held = base.where("dev").groupBy("chunk").cogroup(replies.where("dev").groupBy("chunk")).applyInPandas(grid, "level long, a long, b long, c long, p3 double, p2 double, p1 double, n long")
    # As many as the grid has cells; a cell stands for its mean estimates. Sorted, so that reruns agree.
    cells = held.groupBy("level", "a", "b", "c").agg(*[F.sum(c).alias(c) for c in ("p3", "p2", "p1", "n")]).collect()
    weights = learn_weights(sorted((r["level"], r["p3"] / r["n"], r["p2"] / r["n"], r["p1"] / r["n"], r["n"]) for r in cells), 1.0 / (v + 1))

    def score(texts, found):
        import pandas as pd

        if not len(texts):
            return pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "held_out": pd.Series(dtype="bool"), "n_tokens": pd.Series(dtype="int64"), "n_known": pd.Series(dtype="int64"), "base_score": pd.Series(dtype="float64"), "score": pd.Series(dtype="float64")})
        sizes, uni, context, two, context2, three = _lookup(list(texts["t"]), found, "total", bits, width)
        at = np.cumsum(sizes) - sizes
        w = weights[_level(context, context2)]
        p = sum(w[:, k] * x for k, x in enumerate(estimates(uni, context, two, context2, three, n))) + w[:, 3] / (v + 1)
        flat = np.log10((uni + 1) / (n + v + 1))
        return pd.DataFrame({"doc_id": texts["doc_id"].astype("Int64"), "held_out": ~texts["train"], "n_tokens": sizes, "n_known": np.add.reduceat((uni > 0).astype(np.int64), at), "base_score": np.add.reduceat(flat, at), "score": np.add.reduceat(np.log10(p), at)})

    scored = base.select("chunk", "doc_id", "t", "train").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_corpus(docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")), place=("file", "row"))


QUERIES = {"op3_lm_score": op3_lm_score}
SQL: dict[str, str] = {}
