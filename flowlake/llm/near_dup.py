"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set form a class, and one signature stands for a class. Banding gives candidates; pairs are
compared batch by batch and pruned as soon as the posterior probability of a similarity at or above the threshold falls
below `miss`; survivors are verified exactly on full shingle sets; connected components follow by alternating large-star
and small-star steps. With 25 bands of 5 rows a pair at 0.85 is no candidate with probability 4e-7, at 0.8 with 5e-5.

A pair is compared in the first band it shares only. Crowded buckets (over CROWD classes) are dealt over blocks of classes by
hash, and each pair of blocks is compared where both blocks are, full sets included, so no task holds a whole bucket and only
links that join what isn't joined yet within the pair of blocks leave it, not all pairs. Nothing about all documents comes to
the driver. Intermediate tables are written to the shared folder.

Words are lower-cased in A-Z; a text of fewer words than the shingle width is one shingle; null and blank texts have no
shingles and link with nothing. Rows with a null id are returned with component_id null and kept true. Repeated rows are
copies of each other; rows of one id share its component. With by_text a row is known by its id and the hash of its text, and
rows with a null id take part, after all others. Other columns aren't carried. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import mix, slices, small, stored, table, word_hashes

BANDS, ROWS, WIDTH, MISS, BLOCK, CROWD = 25, 5, 5, 1e-6, 256, 64
_Q = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the offset of each text's first."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    row = np.repeat(np.arange(len(texts)), counts)
    left = ends[row] - np.arange(len(h)) if len(h) else np.empty(0, np.int64)
    shingle = np.zeros(len(h), np.uint64)
    for k in range(width):
        ok = left > k
        shingle[ok] += h[np.flatnonzero(ok) + k] * _Q[k]
    short = counts[row] < width if len(h) else np.empty(0, bool)
    use = np.where(short, np.arange(len(h)) == begins[row], left >= width) if len(h) else np.empty(0, bool)
    shingle, row = mix(shingle[use]), row[use]
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    shingle, row = shingle[fresh], row[fresh]
    return shingle, np.searchsorted(row, np.arange(len(texts) + 1))


def _class_of(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """63-bit identity of each set; 0 for the empty one."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)))))
    n = np.diff(at).astype(np.uint64)
    found = mix(sums[at[1:]] - sums[at[:-1]] + n * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    return np.where(n == 0, np.uint64(0), found | np.uint64(1)).astype(np.int64)


def signatures(shingle: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each of size hash functions over each non-empty set, 32 bits."""
    state = np.random.default_rng(20)
    a, b = state.integers(1, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1), state.integers(0, 1 << 63, size, np.uint64)
    full = np.diff(at) > 0
    out = np.zeros((len(at) - 1, size), np.uint32)
    if full.any():
        starts = at[:-1][full]
        for j in range(size):
            out[full, j] = np.minimum.reduceat(((shingle * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def fewest_matches(n: int, threshold: float, miss: float) -> int:
    """Least m at which P(similarity >= threshold | m of n equal) >= miss, under a uniform prior."""
    p, total = (1 - threshold) ** (n + 1), 0.0
    for m in range(n + 1):
        total += p
        if total >= miss:
            return m
        p *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
    return n


def _describe(docs: DataFrame, text: str, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                shingle, at = shingle_sets(part.column(1).to_pylist(), width)
                sig = signatures(shingle, at, bands * rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(_class_of(shingle, at)), pa.array([s.tobytes() for s in sig], pa.binary()), part.column(2)], names=["doc_id", "n_shingles", "cls", "sig", "key"])

    return docs.select("doc_id", F.col(text).cast("binary"), F.xxhash64(text).alias("key")).mapInArrow(run, "doc_id long, n_shingles long, cls long, sig binary, key long")


def _band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            key = np.zeros(sig.shape[:2], np.uint64)
            for r in range(rows):
                key = mix(key + sig[:, :, r] * _Q[r])
            key = mix(key + np.arange(bands, dtype=np.uint64)[None, :] * _Q[rows])
            cls = np.repeat(batch.column(0).to_numpy(), bands)
            number = np.tile(np.arange(bands, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(key.ravel().view(np.int64)), pa.array(number)], names=["cls", "band", "no"])

    return classes.select("cls", "sig").mapInArrow(run, "cls long, band long, no int")


def _linked(x: bytes, y: bytes, num: int, den: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _forest(a: np.ndarray, b: np.ndarray, sets: dict[int, bytes], num: int, den: int) -> np.ndarray:
    """Which of the pairs, likeliest first, are links that join what earlier ones don't."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = find(x), find(y)
        if rx != ry and _linked(sets[x], sets[y], num, den):
            root[rx] = ry
            keep[k] = True
    return keep


def _compare(num: int, den: int, miss: float, bands: int, rows: int, verify: bool):
    """Rows sorted by (band, i, j) to pairs of classes that survive the sequential test; with verify, to links that span them."""
    threshold = num / den
    size = bands * rows
    steps = [(n, fewest_matches(n, threshold, miss)) for n in sorted({min(size, s) for s in (rows * 5, rows * 10, rows * 15, size)})]

    def pairs(group: list) -> tuple[np.ndarray, np.ndarray]:
        cls = np.array([g[0] for g in group], np.int64)
        block = np.array([g[1] for g in group])
        sig = np.frombuffer(b"".join(g[2] for g in group), np.uint32).reshape(-1, size)
        i, j = group[0][3], group[0][4]
        left, right = (np.triu_indices(len(cls), 1)) if i == j else (x.ravel() for x in np.meshgrid(np.flatnonzero(block == i), np.flatnonzero(block == j), indexing="ij"))
        found: list = []
        mine = group[0][5]
        for at in range(0, len(left), 20_000):
            a, b = left[at : at + 20_000], right[at : at + 20_000]
            done = 0
            matches = np.zeros(len(a), np.int32)
            for n, least in steps:
                matches += (sig[a, done:n] == sig[b, done:n]).sum(1, dtype=np.int32)
                ok = matches >= least
                a, b, matches, done = a[ok], b[ok], matches[ok], n
            same = (sig[a] == sig[b]).reshape(-1, bands, rows).all(2)
            first = same.argmax(1) == mine  # each pair in the first band that it shares, by the values that made the buckets
            found.append((cls[a[first]], cls[b[first]], matches[first]))
        a, b, matches = (np.concatenate([f[k] for f in found] or [cls[:0]]) for k in range(3))
        if verify and len(a):
            order = np.argsort(-matches, kind="stable")
            a, b = a[order], b[order]
            keep = _forest(a, b, {g[0]: g[6] for g in group}, num, den)
            a, b = a[keep], b[keep]
        return a, b

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group: list = []
        key = None
        out: list = []

        def close():
            if len(group) > 1:
                out.append(pairs(group))

        def emit():
            a, b = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            full = batch.column(7).to_pylist() if verify else [None] * batch.num_rows
            for band, i, j, cls, block, sig, no, members in zip(*columns, full, strict=True):
                if (band, i, j) != key:
                    close()
                    group, key = [], (band, i, j)
                    if len(out) >= 2000:
                        yield emit()
                group.append((cls, block, sig, i, j, no, members))
        close()
        if out:
            yield emit()

    return run


def _members(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """Classes of buckets that hold more than one: cls, band, no, n (of the bucket), sig."""
    keys = stored(_band_keys(classes, bands, rows))
    shared = keys.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return stored(keys.join(shared, "band")).join(classes.select("cls", "sig"), "cls")


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members once for each pair of blocks that theirs is in, sorted by band and pair."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rest = [c for c in members.columns if c in ("members",)]
    members = members.select("cls", "band", "no", "sig", *rest, blocks.alias("nb"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
    spread = members.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    spread = spread.select("band", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "cls", "block", "sig", "no", *rest)
    return spread.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def near_duplicates(docs: DataFrame, text: str = "text", num: int = 80, den: int = 100, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block: int = BLOCK, crowd: int = CROWD, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (by_text: and key, the text's hash; kept is the component's first id and key); links are den * intersection >= num * union of the shingle sets."""
    told = stored(_describe(docs, text, width, bands, rows))
    named = told.where((F.col("n_shingles") > 0) & (F.col("doc_id").isNotNull() | F.lit(by_text)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "sig")).alias("m")
    classes = named.groupBy("cls").agg(first).select("cls", F.struct("m.no_id", "m.doc_id", "m.key").alias("rep"), F.col("m.sig").alias("sig"))
    classes = stored(classes)
    members = _members(classes, bands, rows)
    few, many = members.where(F.col("n") <= crowd), members.where(F.col("n") > crowd)
    pairs = stored(_dealt(few, block).mapInArrow(_compare(num, den, miss, bands, rows, False), "a long, b long").distinct())
    links = _verify(pairs, _sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")), classes, docs, text, width), num, den)
    crowds = many.join(_sets(many.select("cls"), classes, docs, text, width), "cls")
    spanning = _dealt(crowds, block).mapInArrow(_compare(num, den, miss, bands, rows, True), "a long, b long")
    links = stored(links.union(spanning).distinct())
    roots = components(links)
    label = roots.join(classes.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("component")).join(roots, "root").select("cls", "component")
    label = classes.select("cls", "rep").join(label, "cls", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    # Stored, so that both sides of the join are plain exchanges: a class with very many copies is then split as a skewed join.
    out = told.drop("sig").join(stored(label), "cls", "left")
    if by_text:
        first = F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("key") == F.col("component.key"))
        component = F.when(F.col("n_shingles") > 0, F.col("component.doc_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), ((F.col("n_shingles") == 0) | first).alias("kept"), "key")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component.doc_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """cls and its full set (packed hashes) of the wanted classes, made again from one text each."""
    need = stored(wanted.distinct().join(classes.select("cls", "rep"), "cls"))

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                shingle, at = shingle_sets(part.column(1).to_pylist(), width)
                cls = _class_of(shingle, at)
                want = part.column(0).to_numpy()
                ok = np.flatnonzero(cls == want)  # ids may repeat with other texts
                yield pa.RecordBatch.from_arrays([pa.array(cls[ok]), pa.array([shingle[at[k] : at[k + 1]].tobytes() for k in ok], pa.binary())], names=["cls", "members"])

    same = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("key") == F.col("rep.key"))
    texts = docs.select("doc_id", F.xxhash64(text).alias("key"), F.col(text).cast("binary").alias("t")).join(small(need), same).select("cls", "t")
    return stored(texts.mapInArrow(sets, "cls long, members binary").dropDuplicates(["cls"]))


def _verify(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ok = [k for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if _linked(x, y, num, den)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(ok, pa.int64()))

    left, right = full.select(F.col("cls").alias("a"), F.col("members").alias("x")), full.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """cls, root for every node of the links (a, b): large-star and small-star until nothing changes. A hub's neighbours are dealt over tasks, since only minima are grouped."""
    edges, before = links, None

    def to_least(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")

    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = to_least(both).where(F.col("v") > F.col("u")).select("v", "m").distinct()
        down = large.where(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        star = to_least(down)
        edges = star.select(F.col("v").alias("a"), F.col("m").alias("b")).union(star.select(F.col("u").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        edges = stored(edges)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("cls"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("cls"), F.col("b").alias("root"))).distinct()


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), num=85)


QUERIES = {"op9_near_dup": op9_near_dup}
SQL: dict[str, str] = {}
