"""Cropped and edited copies of images by local descriptors.

Corners are the local maxima of the Harris response at several scales.  Each gets
the direction of its surroundings' centroid and 128 binary tests of smoothed
brightness, turned into that direction.  Descriptors meet in four Hamming tables,
one for each 32-bit word (two that differ in at most three bits share a word); two
images are copies if enough of their matched corners agree on one turn, scale and
shift.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.components import connected_components
from citegraph.llm.shared import by_value, small_batches, written

by_value(__name__)

SCALES, RADIUS, TURNS, WORDS = (1, 2), 15, 32, 4
#: Bits in which two descriptors of one corner may differ, and corners that must agree.
DISTANCE, INLIERS = 24, 6
#: Share of an image's strongest response that a corner needs.
LEAST_RESPONSE = 0.02
#: Members of a bucket that are compared at once, and images of small buckets with one leader.
BLOCK, GROUP = 64, 512
_TESTS: dict[int, np.ndarray] = {}


def _tests() -> np.ndarray:
    """Offsets of the 128 tests, (TURNS, 128, 2 points, y and x), fixed by a congruential generator."""
    if 0 not in _TESTS:
        x, draws = 12345, []
        for _ in range(128 * 4):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            draws.append((x >> 33) % (2 * RADIUS + 1) - RADIUS)
        points = np.array(draws, float).reshape(128, 2, 2)
        length = np.sqrt((points**2).sum(-1, keepdims=True))
        points = np.where(length > RADIUS, points * RADIUS / np.maximum(length, 1), points)
        turns = []
        for t in range(TURNS):
            a = 2 * np.pi * t / TURNS
            turns.append(np.stack([points[..., 0] * np.cos(a) + points[..., 1] * np.sin(a), points[..., 1] * np.cos(a) - points[..., 0] * np.sin(a)], -1))
        _TESTS[0] = np.array(turns)
    return _TESTS[0]


def _box(img: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r+1, edges repeated."""
    p = np.pad(img, r + 1, mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n])[: img.shape[0], : img.shape[1]] / (n * n)


def _greatest(a: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of side 2r+1, one axis after the other."""
    for _ in range(2):
        wide, n = np.pad(a, ((r, r), (0, 0)), constant_values=-np.inf), a.shape[0]
        a = wide[:n]
        for k in range(1, 2 * r + 1):
            a = np.maximum(a, wide[k : k + n])
        a = a.T
    return a


def corners(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, scale, turn, descriptors as 4 words) of all corners of a grey image, none if it is flat or small."""
    ys, xs, scales, turns, words = [], [], [], [], []
    img = img.astype(np.float64)
    for scale in SCALES:
        edge = RADIUS * scale + 1
        if min(img.shape) <= 2 * edge:
            continue
        smooth = _box(_box(img, scale), scale)
        gy, gx = np.gradient(smooth)
        yy, xx, xy = _box(gy * gy, 2 * scale), _box(gx * gx, 2 * scale), _box(gx * gy, 2 * scale)
        response = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        peak = (response >= _greatest(response, 2 * scale)) & (response > max(LEAST_RESPONSE * response.max(), 1e-6))
        peak[:edge] = peak[-edge:] = False
        peak[:, :edge] = peak[:, -edge:] = False
        y, x = np.nonzero(peak)
        if not len(y):
            continue
        d = np.arange(-RADIUS, RADIUS + 1) * scale
        dy, dx = np.meshgrid(d, d, indexing="ij")
        disc = dy**2 + dx**2 <= (RADIUS * scale) ** 2
        patch = smooth[y[:, None] + dy[disc], x[:, None] + dx[disc]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2(patch @ dy[disc], patch @ dx[disc])
        turn = np.round(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        at = np.round(_tests()[turn] * scale).astype(int)
        value = smooth[np.clip(y[:, None, None] + at[..., 0], 0, img.shape[0] - 1), np.clip(x[:, None, None] + at[..., 1], 0, img.shape[1] - 1)]
        bits = value[..., 0] > value[..., 1] + 0.5  # what is even stays even under slight edits
        ys.append(y)
        xs.append(x)
        scales.append(np.full(len(y), scale))
        turns.append(turn)
        words.append(np.packbits(bits, axis=1).view(np.uint32))
    if not ys:
        return (np.empty(0, int),) * 4 + (np.empty((0, WORDS), np.uint32),)
    return tuple(np.concatenate(v) for v in (ys, xs, scales, turns, words))


def inliers(a: np.ndarray, b: np.ndarray) -> int:
    """Corners of one image that agree with the other's on one similarity; rows of a and b are (y, x, scale, turn, 4 words)."""
    if len(a) < INLIERS or len(b) < INLIERS:
        return 0
    halves = [(x[:, 4:6] << 32 | x[:, 6:8]).astype(np.uint64) for x in (a, b)]
    apart = sum(np.bitwise_count(halves[0][:, None, w] ^ halves[1][None, :, w]) for w in range(2))
    left, right = apart.argmin(1), apart.argmin(0)
    i = np.flatnonzero((right[left] == np.arange(len(a))) & (apart[np.arange(len(a)), left] <= DISTANCE))
    if len(i) < INLIERS:
        return 0
    p, q = a[i], b[left[i]]
    # Each match proposes a turn (from the directions) and a shift, under the scales' ratio; the others vote.
    ratio, turn = (q[:, 2] / p[:, 2])[:, None], (2 * np.pi * (q[:, 3] - p[:, 3]) / TURNS)[:, None]
    dy, dx = (p[None, :, 0] - p[:, None, 0]) * ratio, (p[None, :, 1] - p[:, None, 1]) * ratio
    oy = q[:, None, 0] + dy * np.cos(turn) + dx * np.sin(turn)
    ox = q[:, None, 1] + dx * np.cos(turn) - dy * np.sin(turn)
    allowed = 2.5 + 0.12 * np.hypot(dy, dx)
    return int((np.hypot(q[None, :, 0] - oy, q[None, :, 1] - ox) <= allowed).sum(1).max())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.string()), ("corners", pa.list_(pa.int64())), ("tables", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for key, pixels, width in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            img = np.frombuffer(pixels, np.uint8)
            width = width if width and width > 0 else 1
            y, x, scale, turn, words = corners(img[: len(img) // width * width].reshape(-1, width))
            flat = np.concatenate([np.stack([y, x, scale, turn], 1).astype(np.int64), words.astype(np.int64)], 1)
            tables = np.unique(words.astype(np.int64) | (np.arange(WORDS, dtype=np.int64) << 32))
            rows.append({"rep": key, "corners": flat.ravel().tolist(), "tables": tables.tolist()})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _boxes(col: pa.Array) -> list[np.ndarray]:
    """The corners of each row, 8 numbers each, without a copy."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, off = col.values.to_numpy(), col.offsets.to_numpy()
    return [flat[lo:hi].reshape(-1, 8) for lo, hi in zip(off[:-1], off[1:], strict=True)]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, corners of a, corners of b) those that are copies."""
    for batch in batches:
        good = [inliers(x, y) >= INLIERS for x, y in zip(_boxes(batch.column(2)), _boxes(batch.column(3)), strict=True)]
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _met_before(boxes: list[np.ndarray], asked: np.ndarray, given: np.ndarray, key: int) -> np.ndarray:
    """Whether the images `asked` and `given` also share a word of a table that comes before `key`."""
    words = [np.unique((b[:, 4:8] | (np.arange(WORDS, dtype=np.int64) << 32)).ravel()) for b in boxes]
    words = [w[: np.searchsorted(w, key)] for w in words]
    owner = np.repeat(np.arange(len(boxes)), [len(w) for w in words])
    known, code = np.unique(np.concatenate(words), return_inverse=True)
    out = np.zeros((len(asked), len(given)), bool)
    for low in range(0, len(known), 8192):
        has, here = np.zeros((len(boxes), 8192), np.float32), (code >= low) & (code < low + 8192)
        has[owner[here], code[here] - low] = 1
        out |= has[asked] @ has[given].T > 0
    return out


def _may_agree(boxes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the images a[i] and b[i] each have INLIERS corners within DISTANCE of one of the other's; without them `inliers` accepts none.

    Pairs with very many corners are let through.
    """
    n = np.array([len(x) for x in boxes])
    off = np.cumsum(n) - n
    flat = np.concatenate(boxes)
    half = [(flat[:, k] << 32 | flat[:, k + 1]).astype(np.uint64) for k in (4, 6)]
    out = n[a] * n[b] > 1 << 20
    todo = np.flatnonzero(~out & (n[a] >= INLIERS) & (n[b] >= INLIERS))
    piece = np.cumsum(n[a[todo]] * n[b[todo]]) >> 20
    for part in np.split(todo, np.flatnonzero(np.diff(piece)) + 1):
        p, q = a[part], b[part]
        # One row for each corner of a, then one entry for each corner of b.
        owner = np.repeat(np.arange(len(part)), n[p])
        row = np.arange(len(owner)) + np.repeat(off[p] - (np.cumsum(n[p]) - n[p]), n[p])
        wide = n[q][owner]
        begin = np.cumsum(wide) - wide
        col = np.arange(wide.sum()) + np.repeat(off[q][owner] - begin, wide)
        apart = sum(np.bitwise_count(np.repeat(h[row], wide) ^ h[col]) for h in half)
        hit = np.flatnonzero(apart <= DISTANCE)
        line = np.searchsorted(begin, hit, "right") - 1
        rows = np.bincount(owner[np.unique(line)], minlength=len(part))
        cols = np.bincount(np.unique(owner[line] * len(flat) + col[hit]) // len(flat), minlength=len(part))
        out[part] = (rows >= INLIERS) & (cols >= INLIERS)
    return out


def _first_shared(boxes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words that several images have, ascending, and for each two images the index of the first one both have, else -1."""
    m = len(boxes)
    code = np.concatenate([((b[:, 4:8] | (np.arange(WORDS, dtype=np.int64) << 32)) * m + i).ravel() for i, b in enumerate(boxes)])
    key, owner = np.divmod(np.unique(code), m)
    known, begin, count = np.unique(key, return_index=True, return_counts=True)
    common = count > 1
    known, begin, count = known[common], begin[common], count[common]
    first = np.full(m * m, -1, np.int64)
    order = np.arange(len(known))[::-1]  # of what is written to one place the last stays
    for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(count[order] ** 2) >> 20)) + 1):
        c = count[part]
        member = np.arange(c.sum()) + np.repeat(begin[part] - (np.cumsum(c) - c), c)
        wide = np.repeat(c, c)
        left = np.repeat(owner[member], wide)
        right = owner[np.arange(wide.sum()) + np.repeat(np.repeat(begin[part], c) - (np.cumsum(wide) - wide), wide)]
        first[left * m + right] = np.repeat(np.repeat(part, c), wide)
    return known, first.reshape(m, m)


def _within(table: pa.Table) -> pa.Table:
    """Links that join the images of some buckets with one leader, found by comparing all that share a bucket here first and are not yet joined."""
    table = table.sort_by("rep")
    reps, boxes = table["rep"].to_numpy(), _boxes(table["corners"])
    known, first = _first_shared(boxes)
    here = np.isin(known, table["keys"].combine_chunks().values.to_numpy())
    a, b = np.nonzero(np.triu(first >= 0, 1) & here[first] if len(known) else np.zeros((0, 0), bool))
    keep = _may_agree(boxes, a, b)
    comp, links = np.arange(len(reps)), []
    for i, j in zip(a[keep], b[keep], strict=True):
        if comp[i] != comp[j] and inliers(boxes[i], boxes[j]) >= INLIERS:
            comp[comp == comp[j]] = comp[i]
            links.append((reps[i], reps[j]))
    return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})


def _compare(table: pa.Table) -> pa.Table:
    """Links between the queries and the targets of one block pair, at most one for each two components.

    Two images are compared in the first bucket that they share alone, and once if both ask.
    """
    reps, comps, boxes = table["rep"].to_numpy(), table["comp"].to_numpy(), _boxes(table["corners"])
    role, asks = (table[c].to_numpy() for c in ("is_query", "asks"))
    asked, given = np.flatnonzero(role), np.flatnonzero(~role)
    seen: set[tuple[int, int]] = set()
    if len(asked) and len(given):
        due = (comps[asked][:, None] != comps[given][None, :]) & ~(asks[given][None, :] & (reps[asked][:, None] > reps[given][None, :]))
        if due.any():
            due &= ~_met_before(boxes, asked, given, table["key"][0].as_py())
        a, b = np.nonzero(due)
        keep = _may_agree(boxes, asked[a], given[b])
        for i, j in zip(asked[a[keep]], given[b[keep]], strict=True):
            pair = (int(min(comps[i], comps[j])), int(max(comps[i], comps[j])))
            if pair not in seen and inliers(boxes[i], boxes[j]) >= INLIERS:
                seen.add(pair)
    return pa.table({"a": pa.array([p[0] for p in seen], pa.int64()), "b": pa.array([p[1] for p in seen], pa.int64())})


def copies(images: DataFrame) -> DataFrame:
    """(image_id, class_id, n_corners) for every row of `images` (image_id long, pixels binary, grey by rows, width int).

    class_id is the least image_id of those that are copies of each other,
    directly or through others.  Equal images are one; of others, those that share a
    word of a Hamming table are compared: all members of a bucket of at most BLOCK;
    of a larger one first all with its least, then, where it still spans several
    components, those outside its largest component with all but the least, in
    blocks.  A null image is only a copy of null ones, an
    image too small or flat for corners only of its equals; an incomplete last row
    of pixels is left out of the search for corners.  Null ids are carried, never compared.
    """
    source = small_batches(images).select(F.col("image_id").cast("long").alias("image_id"), "pixels", F.col("width").cast("int").alias("width"))
    source = source.withColumn("key", F.sha2(F.concat(F.coalesce("pixels", F.lit(b"")), F.concat_ws(":", F.lit("w"), F.coalesce(F.col("width").cast("string"), F.lit("none")), F.col("pixels").isNull().cast("string")).cast("binary")), 256))
    named = written(source.groupBy("key").agg(F.min("image_id").alias("id")), "images")
    first = source.filter("pixels is not null").select("key", "pixels", "width").dropDuplicates(["key"])
    described = written(first.mapInArrow(_describe, "rep string, corners array<long>, tables array<long>"), "corners")
    byid = written(described.join(named.filter("id is not null"), described["rep"] == named["key"]).select(F.col("id").alias("rep"), "corners", "tables"), "described")

    keyed = byid.select("rep", F.explode("tables").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).filter("n > 1")
    members = written(keyed.join(buckets, "key"), "members")
    box = byid.select("rep", "corners")
    # Buckets of at most BLOCK members: those with one leader together, as they have many members in common, in slices if these are more than GROUP images.
    few = members.filter(F.col("n") <= BLOCK)
    slices = few.select("leader", "rep").distinct().groupBy("leader").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("slices"))
    grouped = few.join(slices, "leader").groupBy("leader", F.expr("pmod(xxhash64(key), slices)").alias("slice"), "rep").agg(F.collect_list("key").alias("keys"))
    within = grouped.join(box, "rep").groupBy("leader", "slice").applyInArrow(_within, "a long, b long")
    # Larger ones: all members with the least.
    many = members.filter(F.col("n") > BLOCK)
    near = many.filter("rep <> leader").select("rep", "leader").distinct()
    sided = near.join(box, "rep").join(box.select(F.col("rep").alias("leader"), F.col("corners").alias("corners2")), "leader")
    starred = sided.select(F.col("rep").alias("a"), F.col("leader").alias("b"), "corners", "corners2").mapInArrow(_pairs, "a long, b long")
    linked = written(within.unionByName(starred), "links")
    labels = connected_components(linked)

    spread = many.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "leader", "n", F.coalesce("label", "rep").alias("comp"))
    split = spread.groupBy("key").agg(F.first("n").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("set")).filter("n > 2 and least <> most")
    split = split.groupBy("n", "set").agg(F.min("key").alias("key"))
    # The least member has met all others, so it takes no part.
    opened = written(spread.filter("rep <> leader").withColumn("n", F.col("n") - 1).join(split.select("key"), "key"), "open")
    largest = opened.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"))
    asked = opened.join(largest, "key").withColumn("is_query", F.col("comp") != F.col("top.comp"))
    blocks = asked.withColumn("q_blocks", F.ceil((F.col("n") - F.col("top.m")) / BLOCK).cast("int")).withColumn("t_blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("spot", F.xxhash64("rep"))
    # Two images with several words in common are both in several buckets; the first of them is open if they are not yet linked, or had one of them as leader.
    queries = blocks.filter("is_query").select("key", "rep", "comp", F.lit(True).alias("is_query"), F.lit(True).alias("asks"), F.pmod("spot", "q_blocks").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("tb"))
    targets = blocks.select("key", "rep", "comp", F.lit(False).alias("is_query"), F.col("is_query").alias("asks"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), F.pmod("spot", "t_blocks").cast("int").alias("tb"))
    rest = queries.unionByName(targets).join(box, "rep").groupBy("key", "qb", "tb").applyInArrow(_compare, "a long, b long")
    merged = connected_components(written(rest.distinct(), "rest"))

    labels = labels.unionByName(merged.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))).join(merged.select(F.col("id").alias("label"), F.col("label").alias("low")), "label", "left")
    final = byid.select("rep", (F.size("corners") / 8).cast("long").alias("n_corners")).join(labels.select(F.col("id").alias("rep"), F.coalesce("low", "label").alias("label")), "rep", "left")
    known = named.join(final, named["id"] == final["rep"], "left").select("key", F.coalesce("label", "id").alias("class_id"), F.coalesce("n_corners", F.lit(0)).alias("n_corners"))
    return source.select("image_id", "key").join(known, "key").select("image_id", "class_id", "n_corners")


def vector_images(vectors: DataFrame, cell: int = 10) -> DataFrame:
    """(image_id, pixels, width) of `vectors` (vec_id, embedding): the numbers, row by row of the largest square, are cells of grey; null or empty vectors are null images."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("image_id", pa.int64()), ("pixels", pa.binary()), ("width", pa.int32())])
        for batch in batches:
            rows = []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                side = int(len(v or []) ** 0.5)
                if not side:
                    rows.append({"image_id": key, "pixels": None, "width": None})
                    continue
                grid = np.nan_to_num(np.array([x if x is not None else 0 for x in v], float))[: side * side].reshape(side, side)
                grid = np.clip(128 + 320 * grid, 0, 255).astype(np.uint8)
                rows.append({"image_id": key, "pixels": np.kron(grid, np.ones((cell, cell), np.uint8)).tobytes(), "width": side * cell})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(draw, "image_id long, pixels binary, width int")
