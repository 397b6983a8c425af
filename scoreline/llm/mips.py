"""Operator 2: maximum inner product search with score-aware quantisation.

Vectors are taken from the sample's median, which moves all scores of a query alike, and split into
length and direction, so neither a common offset nor rows of far larger values cost precision.
Directions are assigned to leaves (k-means of a bounded sample); what the leaf's centre leaves over is
cut into blocks of `BLOCK` dimensions and each block becomes one of 16 codes. Codebooks and codes
minimise the anisotropic loss: error parallel to the vector, which shifts inner products of near
queries, costs eta times the orthogonal error. The parallel error couples the blocks, so codes come
from coordinate descent over blocks and codebooks from the weighted least squares of that loss.

A query looks up its best leaves: as many as the sample's own nearest neighbours need to be found
in `coverage` of cases, so clustered vectors are searched in a few leaves and unstructured ones in
all. Leaves are dealt into groups of bounded size (a large leaf is cut). Each row's code is sent once, to
its group; each query is sent once to every group that holds a leaf it searches. A group's codes are
held in memory with its directions, its queries stream past them: each scans two four-bit codes at a time
through tables of partial inner products. A row whose codes, with what they may hide, reach the query's
floor is scored from its direction in single precision. What codes may hide is the row's own length left over by
them times a share that the sample's nearest show, so there is no fixed number of candidates that close scores could overrun.
The best of all groups are scored exactly in double precision from the original vectors. So for clustered vectors the shuffle grows with the rows; where
all leaves must be searched, it grows with queries x groups.

Only the models and the number of leaves are fitted on a sample (`sample` rows, those with the
smallest hash of id); every row is coded. Vectors that are null, zero, hold null or non-finite components or have another
length than most take no part. Candidates are all rows but those with the query's own id; repeated
rows count one by one. Each row of queries gets its own k neighbours, a repeated one again as many.
Ties go to the smaller id. Null ids take no part. An empty table or one without queries gives no rows.
Extra columns, whatever their names, are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, tidy, written

BLOCK, CODES, THRESHOLD = 2, 16, 0.2
#: Rows of a leaf aimed at, most leaves, the fewest and most rows of a group, and groups aimed at between.
LEAF_ROWS, MOST_LEAVES, FEWEST_ROWS, MOST_ROWS, AIM = 2048, 4096, 4096, 1 << 18, 64
#: Vectors that the quantiser works on at once, and rows of the sample that floors are taken from.
CHUNK, FLOOR_ROWS = 2048, 1 << 14
#: What single precision may cost a score, of the length of its vector.
ROUNDING = 1e-5


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(most.select("d")), F.size("vec") == F.col("d")).drop("d")


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Leaf centres and anisotropic codebooks; arrays of fixed size."""

    def __init__(self, sample: np.ndarray, leaves: int, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.blocks = -(-self.dim // BLOCK)
        self.blocks += self.blocks % 2
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.centres = self.reach = kmeans(sample, min(leaves, len(sample)), 12, rng)
        leaf = nearest(sample, self.centres)
        left, whole = self._cut(sample - self.centres[leaf]), self._cut(sample)
        self.books = np.stack([kmeans(left[:, b], CODES, rounds, rng) for b in range(self.blocks)])
        for _ in range(3):
            self._refit(left, whole, self._codes(left, whole))

    def weigh(self, sample: np.ndarray, lengths: np.ndarray) -> None:
        """Leaves are searched by their centres times the mean length of their vectors."""
        leaf, k = nearest(sample, self.centres), len(self.centres)
        mean = np.bincount(leaf, lengths, k) / np.maximum(np.bincount(leaf, minlength=k), 1)
        self.reach = self.centres * mean[:, None]

    def _cut(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.blocks * BLOCK), np.float32)
        out[:, : self.dim] = x
        return out.reshape(len(x), self.blocks, BLOCK)

    def _codes(self, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        parts = [self._assign(left[i : i + CHUNK], whole[i : i + CHUNK]) for i in range(0, len(left), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros((0, self.blocks), np.int64)

    def _assign(self, left: np.ndarray, whole: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent: |r|^2 + (eta - 1) <r, x>^2 / |x|^2 over the blocks in turn."""
        weight = (self.eta - 1) / np.maximum((whole**2).sum(axis=(1, 2)), 1e-30)
        error = ((left[:, :, None] - self.books[None]) ** 2).sum(axis=3)
        along = np.einsum("nbd,nbd->nb", left, whole)[:, :, None] - np.einsum("bkd,nbd->nbk", self.books, whole)
        codes = error.argmin(axis=2)
        rows = np.arange(len(left))
        parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for b in range(self.blocks):
                rest = parallel - along[rows, b, codes[:, b]]
                codes[:, b] = (error[:, b] + weight[:, None] * (rest[:, None] + along[:, b]) ** 2).argmin(axis=1)
                parallel = rest + along[rows, b, codes[:, b]]
        return codes

    def _refit(self, left: np.ndarray, whole: np.ndarray, codes: np.ndarray) -> None:
        weight = (self.eta - 1) / np.maximum((whole**2).sum(axis=(1, 2)), 1e-30)
        rows = np.arange(len(left))
        for b in range(self.blocks):
            chosen = self.books[np.arange(self.blocks)[None], codes]
            parallel = ((left - chosen) * whole).sum(axis=2)
            rest = parallel.sum(axis=1) - parallel[:, b]
            x, r = whole[rows, b].astype(np.float64), left[rows, b].astype(np.float64)
            outer = np.eye(BLOCK) + weight[:, None, None] * x[:, :, None] * x[:, None, :]
            target = r + (weight * (rest + (r * x).sum(axis=1)))[:, None] * x
            a, t = np.zeros((CODES, BLOCK, BLOCK)), np.zeros((CODES, BLOCK))
            np.add.at(a, codes[:, b], outer)
            np.add.at(t, codes[:, b], target)
            used = np.bincount(codes[:, b], minlength=CODES) > 0
            self.books[b, used] = np.linalg.solve(a[used], t[used][:, :, None])[:, :, 0]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf of each vector, its codes, two in a byte, and the vector that they stand for."""
        leaf = nearest(x, self.centres)
        codes = self._codes(self._cut(x - self.centres[leaf]), self._cut(x))
        stands = self.centres[leaf] + self.books[np.arange(self.blocks)[None], codes].reshape(len(x), -1)[:, : self.dim]
        codes = codes.astype(np.uint8)
        return leaf, codes[:, 0::2] << 4 | codes[:, 1::2], stands

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of code, its 256 partial inner products."""
        single = np.einsum("nbd,bkd->nbk", self._cut(q), self.books)
        return (single[:, 0::2, :, None] + single[:, 1::2, None, :]).reshape(len(q), self.blocks // 2, 256).astype(np.float32)


def _matrix(column: pa.Array, dtype=np.float32, scale: float = 1.0) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat.reshape(len(column), -1) * scale).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def directions(x: np.ndarray, middle: np.ndarray | float = 0.0, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors from middle, in single precision, and lengths; a vector of none has the direction 0."""
    y = x * scale - middle
    top = np.abs(y).max(axis=1, initial=0.0)
    y /= np.where(top > 0, top, 1.0)[:, None]
    length = np.sqrt((y * y).sum(axis=1))
    return (y / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32), top * length


def leaves_needed(model: Quantiser, sample: np.ndarray, k: int, coverage: float, queries: int = 256, lengths: np.ndarray | None = None, asked: np.ndarray | None = None) -> int:
    """The least number of best leaves that hold `coverage` of the k nearest in the sample of its own vectors, or of those asked."""
    if asked is None:
        at = np.random.default_rng(11).choice(len(sample), min(queries, len(sample)), replace=False)
        near = sample[at] @ sample.T
        near[np.arange(len(at)), at] = -np.inf
        asked = sample[at]
    else:
        near = asked @ sample.T
    if lengths is not None:
        near = near * lengths
    best = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k]
    leaf = nearest(sample, model.centres)
    rank = np.argsort(np.argsort(-(asked @ model.reach.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(rank, leaf[best], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(coverage * len(ranks))) - 1)]) + 1


def _dealt(sizes: dict[int, int], leaves: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of each leaf and how many groups it takes: leaves fill groups of up to `most` rows in order, a larger leaf has groups of its own."""
    base, parts = np.zeros(leaves, np.int32), np.ones(leaves, np.int32)
    at, filled = 0, 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        parts[leaf] = max(1, -(-n // most))
        if filled and filled + n > most:
            at, filled = at + 1, 0
        base[leaf] = at
        filled += n
        if parts[leaf] > 1:
            at, filled = at + int(parts[leaf]), 0
    return base, parts


class Floors:
    """Scores that the k best are expected to reach, from rows of the sample, and the share of a row's loss that its codes may hide.

    Of the rows that a query scans, the k best lie above the score of its sample row of rank
    k x share, but for chance; four deviations and two rows are added to that rank. So what a query sends
    to be ranked doesn't grow with the number of groups, as long as the sample holds some of its best.
    """

    def __init__(self, model: Quantiser, sample: np.ndarray, lengths: np.ndarray, k: int, total: int, asked: np.ndarray, coverage: float):
        at = np.linspace(0, len(sample) - 1, min(len(sample), FLOOR_ROWS)).astype(np.int64)
        self.rows, self.lengths = sample[at], lengths[at]
        self.leaf, _, stands = model.encode(self.rows)
        expected = k * min(1.0, len(self.rows) / total)
        self.rank = int(np.ceil(expected + 4 * np.sqrt(expected))) + 2
        left = self.rows - stands
        lost = np.maximum(np.linalg.norm(left, axis=1), 1e-12)
        best = np.argpartition(-(asked @ self.rows.T) * self.lengths, min(k, len(at) - 1), axis=1)[:, :k]
        hidden = np.einsum("qd,qkd->qk", asked, left[best]) / lost[best]
        self.hidden = float(np.clip(np.quantile(hidden, coverage), 0, 1)) if hidden.size else 1.0

    def of(self, q: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The floor of each query that searches these of its leaves (booleans); -inf where the sample can't tell."""
        out = np.full(len(q), -np.inf)
        for i in range(0, len(q), 256):
            near = np.where(leaves[i : i + 256, self.leaf], (q[i : i + 256] @ self.rows.T) * self.lengths, -np.inf)
            if self.rank <= near.shape[1]:
                out[i : i + 256] = np.partition(near, near.shape[1] - self.rank, axis=1)[:, near.shape[1] - self.rank]
        return out


def _best(near: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest values; of equal ones the first."""
    if len(near) <= most:
        return np.arange(len(near))
    least = np.partition(near, len(near) - most)[len(near) - most]
    above, level = np.flatnonzero(near > least), np.flatnonzero(near == least)
    return np.concatenate((above, level[: most - len(above)]))


def _scan(model: Quantiser, searched: int, kept: int, hidden: float, ids: np.ndarray, leaf: np.ndarray, packed: np.ndarray, unit: np.ndarray, length: np.ndarray, lost: np.ndarray, query_ids: np.ndarray, keys: np.ndarray, q: np.ndarray, floors: np.ndarray):
    """For each query the key, ids and scores of the kept best of a group's rows that reach its floor; rows are in id order."""
    base, reach = q @ model.centres.T, q @ model.reach.T
    if searched < base.shape[1]:
        # leaves that a query doesn't search are out of its reach
        np.put_along_axis(base, np.argsort(-reach, axis=1, kind="stable")[:, searched:], -np.inf, 1)
    rounding = ROUNDING * length
    slack = rounding + hidden * lost
    for i in range(0, len(q), 64):
        for j, tables in enumerate(model.tables(q[i : i + 64]), i):
            near = base[j][leaf]
            for b in range(len(packed)):
                near += tables[b][packed[b]]
            near = near * length + slack
            near[ids == query_ids[j]] = -np.inf
            at = np.flatnonzero(np.isfinite(near))
            floor = floors[j]
            if len(at) > kept:
                # the group's own kept-th best, from the rows that look best, may lie above the sample's floor
                first = at[_best(near[at], kept)]
                floor = max(floor, (np.einsum("nd,d->n", unit[first], q[j]) * length[first] - rounding[first]).min())
            at = at[near[at] >= floor]
            # a row's sum doesn't depend on its place, so copies have equal scores
            score = np.einsum("nd,d->n", unit[at], q[j]) * length[at]
            reaches = score + rounding[at] >= floors[j]
            at, score = at[reaches], score[reaches]
            first = _best(score, kept)
            yield keys[j], ids[at[first]], score[first]


def search(df: DataFrame, queries: DataFrame, k: int = 20, kept: int = 200, coverage: float = 0.98, sample: int = 40_960, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row of queries.

    queries has the columns of df. kept candidates a query are scored exactly.
    """
    spark = df.sparkSession
    rows = written(usable(df, id_col, vec_col))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = lambda c: F.array_max(F.transform(c, F.abs))
    dim, largest = rows.agg(F.first(F.size("vec")), F.max(size("vec"))).first()  # one row
    scale = 1 / largest  # lengths stay far from the largest double; order stays
    asked = usable(queries, id_col, vec_col).where(F.size("vec") == dim).groupBy(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")).agg(F.count("*").alias("repeats"))
    asked = written(asked.withColumn("key", F.xxhash64("query_id", "query")))
    share = min(1.0, sample / total)
    got = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy("vec_id").select("vec").limit(2 * sample).toArrow().column("vec").combine_chunks()  # bounded by sample
    drawn = _matrix(got, np.float64) if len(got) else np.asarray(rows.select("vec").first()[0], np.float64)[None]
    middle = np.median(drawn * scale, axis=0)
    fitted, lengths = directions(drawn, middle, scale)
    some = asked.orderBy("key").select("query").limit(256).toArrow().column("query").combine_chunks()  # 256 rows
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = directions(_matrix(some, np.float64))[0]
    quantiser = Quantiser(fitted, int(np.clip(round(total / LEAF_ROWS), 1, MOST_LEAVES)))
    leaves = len(quantiser.centres)
    quantiser.weigh(fitted, lengths)
    searched = leaves_needed(quantiser, fitted, k, coverage, lengths=lengths, asked=some)
    model = spark.sparkContext.broadcast(quantiser)  # centres and codebooks of fixed size
    floors = spark.sparkContext.broadcast(Floors(quantiser, fitted, lengths, k, total, some, 1 - (1 - coverage) / 4))  # at most FLOOR_ROWS vectors

    code_schema = pa.schema([("vec_id", pa.int64()), ("leaf", pa.int32()), ("salt", pa.int32()), ("code", pa.binary()), ("unit", pa.binary()), ("length", pa.float64()), ("lost", pa.float64())])

    @tidy
    def encode(batches):
        seen = 0
        for batch in batches:
            unit, length = directions(_matrix(batch.column("vec"), np.float64), middle, scale)
            leaf, packed, stands = model.value.encode(unit)
            lost = np.linalg.norm(unit - stands, axis=1) * length
            # salts deal a large leaf's rows, also those with one id
            salt = (seen + np.arange(batch.num_rows)) % (1 << 30)
            seen += batch.num_rows
            yield batch_of(code_schema, vec_id=batch.column("vec_id").to_numpy(), leaf=leaf.astype(np.int32), salt=salt.astype(np.int32), code=[c.tobytes() for c in packed], unit=[u.tobytes() for u in unit], length=length, lost=lost)

    coded = written(rows.mapInArrow(encode, "vec_id long, leaf int, salt int, code binary, unit binary, length double, lost double"))

    # at most MOST_LEAVES rows
    sizes = {r["leaf"]: r["n"] for r in coded.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    base, parts = _dealt(sizes, leaves, int(np.clip(total // AIM, FEWEST_ROWS, MOST_ROWS)))
    groups = int((base + parts).max())
    table = F.broadcast(spark.createDataFrame([(i, int(base[i]), int(parts[i])) for i in range(leaves)], "leaf int, base int, parts int"))
    null = lambda t: F.lit(None).cast(t)
    left = coded.join(table, "leaf").select((F.col("base") + F.pmod("salt", F.col("parts"))).cast("int").alias("g"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), null("long").alias("key"), "leaf", "code", "unit", "length", "lost", null("array<float>").alias("query"), null("double").alias("floor"))

    @tidy
    def route(batches):
        for batch in batches:
            asking = directions(_matrix(batch.column("query"), np.float64))[0]
            score = asking @ model.value.reach.T
            best = np.argsort(-score, axis=1, kind="stable")[:, :searched]
            met = np.zeros((len(best), groups), bool)
            for extra in range(int(parts.max())):
                row, at = np.nonzero(parts[best] > extra)
                met[row, base[best[row, at]] + extra] = True
            at, g = np.nonzero(met)
            mine = np.zeros(score.shape, bool)
            np.put_along_axis(mine, best, True, 1)
            floor = floors.value.of(asking, mine)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("query_id", "key", "query")), pa.array(g.astype(np.int32)), pa.array(floor[at])], names=["query_id", "key", "query", "g", "floor"])

    directed = asked.select("query_id", "key", F.transform("query", lambda x: (x / size("query")).cast("float")).alias("query"))
    routed = directed.mapInArrow(route, "query_id long, key long, query array<float>, g int, floor double")
    right = routed.select("g", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "key", null("int").alias("leaf"), null("binary").alias("code"), null("binary").alias("unit"), null("double").alias("length"), null("double").alias("lost"), "query", "floor")
    found_schema = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("near", pa.float64())])

    @tidy
    def scan(batches):
        """Batches come by group, codes before queries: only a group's codes and directions are held."""
        group, held, ready = None, [], None
        for batch in batches:
            g, kind = batch.column("g").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if e == s:
                    continue
                part = batch.slice(s, e - s)
                if g[s] != group:
                    group, held, ready = g[s], [], None
                ids = part.column("id").to_numpy()
                if not kind[s]:
                    raw = lambda c, t: np.frombuffer(b"".join(part.column(c).to_pylist()), t).reshape(len(ids), -1)  # noqa: B023, E731
                    held.append((ids, part.column("leaf").to_numpy(), raw("code", np.uint8), raw("unit", np.float32), part.column("length").to_numpy(), part.column("lost").to_numpy()))
                    continue
                if ready is None and held:
                    own, leaf, code, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(own, kind="stable")
                    ready, held = (own[order], leaf[order], np.ascontiguousarray(code[order].T), *(x[order] for x in rest)), []
                if ready is not None:
                    best = list(_scan(model.value, searched, kept, floors.value.hidden, *ready, ids, part.column("key").to_numpy(), directions(_matrix(part.column("query"), np.float64))[0], part.column("floor").to_numpy()))
                    key = np.repeat(np.array([b[0] for b in best], np.int64), [len(b[1]) for b in best])
                    yield batch_of(found_schema, key=key, vec_id=np.concatenate([b[1] for b in best]), near=np.concatenate([b[2] for b in best]))

    found = left.unionByName(right).repartition(groups, "g").sortWithinPartitions("g", "kind").mapInArrow(scan, "key long, vec_id long, near double")
    best = Window.partitionBy("key").orderBy(F.desc("near"), "vec_id")
    short = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= kept).select("key", "vec_id").distinct()
    pairs = short.join(rows, "vec_id").join(asked, "key")
    score_schema = pa.schema([("key", pa.int64()), ("query_id", pa.int64()), ("repeats", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    @tidy
    def exact(batches):
        for batch in batches:
            same = {c: batch.column(c).to_numpy() for c in ("key", "query_id", "repeats", "vec_id")}
            yield batch_of(score_schema, **same, score=np.einsum("nd,nd->n", _matrix(batch.column("query"), np.float64), _matrix(batch.column("vec"), np.float64)))

    scored = pairs.select("key", "query_id", "repeats", "vec_id", "query", "vec").mapInArrow(exact, "key long, query_id long, repeats long, vec_id long, score double")
    nearest_ = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("rank", F.row_number().over(nearest_)).where(F.col("rank") <= k)
    return top.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("query_id", "rank", "vec_id", "score")
