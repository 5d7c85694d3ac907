"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

Equal lines are one node (a 64-bit hash of the normalised line) from the start, however short. Of the lines
with a shingle at least, a chunk of documents computes the signatures of the distinct ones by
one-permutation hashing and cuts them into bands. The entries of one band are sorted by their similarity marks
in several rotations, and each is compared with those next to it in each order: all pairs of a band of
``NEAR + 1`` entries, the likeliest ones of a larger one, so the work of a chunk grows with its lines and not with their square.
What the marks do not rule out is verified exactly. All entries leave the chunk, packed by range of the band key, and the same
is done with those of all chunks. What the neighbours may miss in a larger band is found exactly: lines of such a band
that are still in different components are compared by sketches that rule out no alike pair, and in a band over ``DIRECT`` lines
they are joined on their rarest shingles first (prefix filter), so no pair that shares a
larger band is left out unless it is in one component already.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .graph import components
from .lm import packed, unpacked

SHINGLE, ROWS, BANDS, SIMILARITY = 5, 6, 20, 0.8
CHUNK_BYTES = 3_000_000
NEAR, ROTATIONS = 4, 8
#: One bit of each of 31 signature bins travels with a line. Lines of similarity s agree in (1 + s) / 2 of them:
#: 28 of 31 on average at 0.8 and 17 at 0.1, so pairs below this are not worth an exact comparison. A line of fewer
#: shingles than ``MARKED`` has too few values for that: its top bit is set and its pairs are always compared.
AGREE, MARKED, SHORT = 21, 30, np.uint32(1 << 31)
#: Into how many parts the members of one class are dealt where they meet its kept line.
SALTS = 16
#: Buckets of shingles whose frequencies go to all tasks.
BUCKETS = 1 << 16
#: Words of 64 bits of a line's sketch, and of one for lines of large bands.
SKETCH, LONG = tuple(f"s{k}" for k in range(4)), tuple(f"s{k}" for k in range(16))
#: Lines of a band up to this size meet each other there, by their sketches; those of larger ones meet on shingles.
DIRECT = 4096
_NONE = np.uint64(2**64 - 1)
_UNTIDY = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c", b"\n ", b" \n")


def normal_lines(data: np.ndarray, offsets: np.ndarray):
    """``(row, line number, text)`` of every line that is not blank: lower-cased, runs of white space made one space."""
    low = shared._LOWER[data].tobytes()
    for row in range(len(offsets) - 1):
        text = low[offsets[row] : offsets[row + 1]]
        # most texts are tidy already, which is quicker to see than to redo
        tidy = text[:1] != b" " and text[-1:] != b" " and not any(x in text for x in _UNTIDY)
        for number, line in enumerate(text.split(b"\n")):
            if not tidy:
                line = b" ".join(line.split())
            if line:
                yield row, number, line


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle of each line, and the line it belongs to. Shingles are of characters; a shorter line has none."""
    data = b"".join(lines)
    if data.isascii():
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        # five bytes are one number, read at every byte
        code = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,)) & np.uint64((1 << 8 * SHINGLE) - 1)
    else:
        texts = [x.decode("utf-8", "replace") for x in lines]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        point = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass") + bytes(4 * SHINGLE), "<u4").astype(np.uint64)
        n = int(sizes.sum())
        code, wide, plain = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(SHINGLE):
            code |= point[j : j + n] << np.uint64(8 * j)
            wide = wide * np.uint64(0x9E3779B97F4A7C15) + point[j : j + n]
            plain &= point[j : j + n] < 128
        # the same number as above for five ASCII characters
        code = np.where(plain, code, shared.mix(wide) | np.uint64(1 << 63))
    whole = np.ones(len(code), bool)
    ends = np.cumsum(sizes)
    for j in range(1, SHINGLE):
        whole[np.maximum(ends - j, ends - sizes)[sizes > 0]] = False
    code = code[whole] * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(29)
    return code, np.repeat(np.arange(len(lines)), np.maximum(sizes - SHINGLE + 1, 0))


def signatures(code: np.ndarray, line: np.ndarray, n: int, width: int) -> np.ndarray:
    """One-permutation MinHash: the least hash in each of ``width`` bins. An empty bin takes that of a filled one, looked for
    in an order of its own that all lines share, so that bins next to each other do not take the same one."""
    bin_of = ((code >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
    out = np.full(n * width, _NONE)
    np.minimum.at(out, line * width + bin_of, code & np.uint64(0xFFFFFFFF))
    out = out.reshape(n, width)
    filled = out != _NONE
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    order, turn = _search_order(width), 0
    while len(row):
        # several turns at once, more of them the fewer bins are left
        tried = order[turn : turn + (2 if turn < 4 else 4 if turn < 16 else 32)]
        hits = filled[row[:, None], tried.T[column]]
        hit = hits.any(axis=1)
        other = tried[hits[hit].argmax(axis=1), column[hit]]
        out[row[hit], column[hit]] = out[row[hit], other]
        row, column, turn = row[~hit], column[~hit], turn + len(tried)
    return out


@lru_cache
def _search_order(width: int) -> np.ndarray:
    """In which bin each bin looks at each turn; after many turns the bins are tried one by one, so that each search ends."""
    turn, column = np.arange(1, 5 * width, dtype=np.uint64)[:, None], np.arange(width, dtype=np.uint64)
    return np.where(turn < 4 * width, shared.mix(column + np.uint64(width) * turn) % np.uint64(width), (column + turn) % np.uint64(width)).astype(np.int64)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            key = shared.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        out[:, b] = key
    return out


def shingle_sets(lines: list[bytes]) -> list[frozenset]:
    code, line = shingle_hashes(lines)
    cuts = np.searchsorted(line, np.arange(len(lines) + 1)).tolist()
    code = code.tolist()
    return [frozenset(code[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distinct_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each line, the line each belongs to, in ascending order, and how many each line has."""
    code, line = shingle_hashes(lines)
    order = np.lexsort((code, line))
    code, line = code[order], line[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (line[1:] != line[:-1])
    return code[fresh], line[fresh], np.bincount(line[fresh], minlength=len(lines))


def sketches(code: np.ndarray, line: np.ndarray, n: int, words: int) -> np.ndarray:
    """For each of ``n`` lines whether its number of shingles is odd in each class of hashes, in so many words: sketches differ in no more bits than the sets in shingles."""
    bits = 64 * words
    odd = np.bincount(line * bits + (code % np.uint64(bits)).astype(np.int64), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _sketched(words: tuple[str, ...]):
    def task(batches):
        for batch in batches:
            code, line, n = distinct_shingles(batch.column("line").to_pylist())
            made = sketches(code, line, len(n), len(words)).T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32()), *map(pa.array, made)], names=[*batch.schema.names, "n", *words])

    return task


def _with_sketch(lines: DataFrame, words: tuple[str, ...] = SKETCH) -> DataFrame:
    """Rows with a ``line`` and the number ``n`` of its shingles and its sketch."""
    kinds = [f"{c} {t}" for c, t in lines.dtypes] + ["n int"] + [f"{w} long" for w in words]
    return lines.mapInArrow(_sketched(words), ", ".join(kinds))


def _end(df: DataFrame, x: str) -> DataFrame:
    """One end of a pair: ``node`` is called ``x``, and all columns that both ends have end in ``x``."""
    return df.withColumnsRenamed({c: x if c == "node" else f"{c}_{x}" for c in df.columns if c not in ("key", "code")})


def _may_be_alike(words: tuple[str, ...] = SKETCH) -> Column:
    """Whether the sets of ends ``a`` and ``b`` can be alike by their sketches: alike ones differ in a ninth of both together at most, so no alike pair is lost."""
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    return 9 * apart <= F.col("n_a") + F.col("n_b")


def alike(a: frozenset, b: frozenset) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < SIMILARITY * len(large):
        return False
    common = len(small & large)
    return common > 0 and common >= SIMILARITY * (len(a) + len(b) - common)


def _find(ranges: int):
    """Rows of one chunk: verified links (range -1) and packed entries by range of the band key."""
    edges = (np.arange(1, ranges, dtype=object) * 2**64 // ranges).astype(np.uint64)
    names = ["r", "keys", "nodes", "marks"]

    def rows_of(lines: dict[int, bytes]):
        # lines of ASCII first, as their shingles are quicker to read
        order = sorted(lines, key=lambda k: (not lines[k].isascii(), k))
        nodes, texts = np.array(order, np.uint64), [lines[k] for k in order]
        keys, marks, signed = np.empty((len(nodes), BANDS), np.uint64), np.empty(len(nodes), np.uint32), np.zeros(len(nodes), bool)
        for at in range(0, len(texts), 1500):
            code, line = shingle_hashes(texts[at : at + 1500])
            n = len(texts[at : at + 1500])
            found = signatures(code, line, n, ROWS * BANDS)
            keys[at : at + n] = band_keys(found, ROWS, BANDS)
            shingles = np.bincount(line, minlength=n)
            bits = np.packbits((shared.mix(found[:, :32]) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint32)[:, 0]
            marks[at : at + n] = np.where(shingles < MARKED, bits | SHORT, bits & ~SHORT)
            signed[at : at + n] = shingles > 0
        nodes, texts, keys, marks = nodes[signed], [t for t, ok in zip(texts, signed.tolist(), strict=True) if ok], keys[signed], marks[signed]
        flat, owner = keys.reshape(-1), np.repeat(np.arange(len(nodes)), BANDS)
        order = np.lexsort((owner, flat))
        flat, owner = flat[order], owner[order]
        run = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
        # candidates within the chunk are found as across chunks: neighbours by mark, all pairs of a small band
        met = [np.zeros(0, np.int64)]
        shared_by = np.repeat(np.diff(run), np.diff(run))
        several = np.flatnonzero(shared_by > 1)
        for i, j in _near(flat[several], marks[owner[several]]):
            x, y = owner[several[i]], owner[several[j]]
            like = (np.bitwise_count((marks[x] ^ marks[y]) & ~SHORT) <= 31 - AGREE) | ((marks[x] | marks[y]) >= SHORT)
            met.append(np.minimum(x, y)[like] * len(nodes) + np.maximum(x, y)[like])
        met = np.unique(np.concatenate(met))
        sets: dict[int, frozenset] = {}
        links = []
        for a, b in zip((met // max(len(nodes), 1)).tolist(), (met % max(len(nodes), 1)).tolist(), strict=True):
            for x in (a, b):
                if x not in sets:
                    sets[x] = shingle_sets([texts[x]])[0]
            if alike(sets[a], sets[b]):
                links.append((a, b))
        cuts = [0, *np.searchsorted(flat, edges).tolist(), len(flat)]
        out = [(r, packed(np.diff(flat[a:b], prepend=np.uint64(0))), packed(nodes[owner[a:b]]), packed(marks[owner[a:b]])) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        if links:
            ends = np.array(links)
            out.append((-1, packed(nodes[ends[:, 0]]), packed(nodes[ends[:, 1]]), b""))
        for at in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 64], strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    def task(batches):
        lines, held = {}, 0
        for batch in batches:
            for node, text in _distinct(batch):
                if node not in lines:
                    lines[node] = text
                    held += len(text)
                    if held >= CHUNK_BYTES:
                        yield from rows_of(lines)
                        lines, held = {}, 0
        if lines:
            yield from rows_of(lines)

    return task


def _distinct(batch):
    from xxhash import xxh3_64_intdigest

    data, offsets = shared.text_buffer(batch.column("text"))
    for a, b in shared.row_groups(offsets):
        part = offsets[a : b + 1]
        for _, _, line in normal_lines(data[part[0] : part[-1]], part - part[0]):
            yield xxh3_64_intdigest(line), line


def _near(key: np.ndarray, mark: np.ndarray):
    """Places ``(i, j)`` to compare: next to each other by mark within one key, in ``ROTATIONS`` orders where one does not bring all together."""
    places = np.arange(len(key))
    for turn in range(ROTATIONS):
        by = np.uint32(turn * 32 // ROTATIONS)
        mine = mark[places]
        turned = (mine << by) | (mine >> (np.uint32(32) - by)) if turn else mine
        order = places[np.lexsort((turned, key[places]))]
        run = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        size = np.diff(np.append(run, len(order)))
        left = np.repeat(run + size, size) - np.arange(len(order)) - 1  # entries after each in its run
        at = np.flatnonzero(left > 0)
        for hop in range(1, NEAR + 1):
            at = at[left[at] >= hop]
            if not len(at):
                break
            yield order[at], order[at + hop]
        if not turn:
            # further orders only where one does not bring all together
            places = np.sort(order[np.repeat(size, size) > NEAR + 1])
            if not len(places):
                return


def _pair(group: pa.Table) -> pa.Table:
    """Candidate pairs of one range of band keys (kind 0); links that chunks found themselves pass through (kind 1). A band of more lines than are
    all compared is listed too, a row for each line and its key (kind 2)."""
    if not group.num_rows or group.column("r")[0].as_py() < 0:
        links = [(unpacked(a.as_py(), "<u8"), unpacked(b.as_py(), "<u8")) for a, b in zip(group.column("keys"), group.column("nodes"), strict=True)]
        a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.uint64),) * 2
        crowd, kind = np.zeros((0, 2), np.uint64), 1
    else:
        key = np.concatenate([np.cumsum(unpacked(x.as_py(), "<u8")) for x in group.column("keys")])
        node = np.concatenate([unpacked(x.as_py(), "<u8") for x in group.column("nodes")])
        mark = np.concatenate([unpacked(x.as_py(), "<u4") for x in group.column("marks")])
        order = np.argsort(key, kind="stable")
        key, node, mark = key[order], node[order], mark[order]
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        several = same[1:] | same[:-1]
        key, node, mark = key[several], node[several], mark[several]
        order = np.lexsort((node, key))
        key, node, mark = key[order], node[order], mark[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])[: len(key)]
        key, node, mark = key[fresh], node[fresh], mark[fresh]
        pairs = [np.zeros((0, 2), np.uint64)]
        for i, j in _near(key, mark) if len(key) else ():
            like = (np.bitwise_count((mark[i] ^ mark[j]) & ~SHORT) <= 31 - AGREE) | ((mark[i] | mark[j]) >= SHORT)
            x, y = node[i[like]], node[j[like]]
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        a, b, kind = pairs[:, 0], pairs[:, 1], 0
        _, band, size = np.unique(key, return_inverse=True, return_counts=True)
        large = size[band] > NEAR + 1 if len(key) else np.zeros(0, bool)
        crowd = np.stack([node[large], key[large]], axis=1)
    table = [pa.array(np.ascontiguousarray(np.concatenate(x)).view(np.int64)) for x in ((a, crowd[:, 0]), (b, crowd[:, 1]))]
    return pa.Table.from_arrays([*table, pa.array(np.repeat([kind, 2], [len(a), len(crowd)]), pa.int32())], names=["a", "b", "kind"])


def _verify(batches):
    """The pairs ``(a, b, la, lb)`` whose lines are alike."""
    for batch in batches:
        ends = [dict(zip(batch.column(n).to_pylist(), batch.column(t).to_pylist(), strict=True)) for n, t in (("a", "la"), ("b", "lb"))]
        texts = ends[0] | ends[1]
        sets = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))
        good = [alike(sets[a], sets[b]) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def line_links(docs: DataFrame) -> DataFrame:
    """Links ``(a long, b long)`` between hashes of lines with a Jaccard similarity of 0.8 or more."""
    spark = docs.sparkSession
    ranges = 4 * shared.partitions(spark, 4)
    shared.small_batches(spark, 1000)
    found = docs.select("text").mapInArrow(_find(ranges), "r int, keys binary, nodes binary, marks binary")
    # links found inside chunks are dealt over many groups, as one would grow with the input
    found = found.withColumn("g", F.when(F.col("r") < 0, -1 - F.pmod(F.xxhash64("keys"), F.lit(ranges))).otherwise(F.col("r")))
    pairs = shared.saved(found.groupBy("g").applyInArrow(_pair, "a long, b long, kind int"), "pairs")
    open_pairs = pairs.where("kind = 0").select("a", "b").distinct()
    crowded = pairs.where("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("key"))
    needed = open_pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowded.select("node")).distinct()

    def texts(batches):
        from itertools import islice

        for batch in batches:
            rows = iter({node: text for node, text in _distinct(batch)}.items())
            while some := list(islice(rows, 2000)):
                nodes = np.array([n for n, _ in some], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([t for _, t in some], pa.binary())], names=["node", "line"])

    lines = docs.select("text").mapInArrow(texts, "node long, line binary").join(needed, "node", "left_semi").dropDuplicates(["node"])
    lines = shared.saved(_with_sketch(lines), "lines")
    # pairs meet the sketches first, and few are left for the texts
    sketch = lines.drop("line")
    near = open_pairs.join(_end(sketch, "a"), "a").join(_end(sketch, "b"), "b").where(_may_be_alike()).select("a", "b")

    links = shared.saved(pairs.where("kind = 1").select("a", "b").union(_verified(near, lines)), "line-near")
    return links.union(_rest_of_crowds(crowded, lines, links))


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The ``pairs (a, b)`` whose ``lines`` are alike."""
    lines = lines.select("node", "line")
    both = pairs.join(lines.withColumnsRenamed({"node": "a", "line": "la"}), "a").join(lines.withColumnsRenamed({"node": "b", "line": "lb"}), "b")
    return both.select("a", "b", "la", "lb").mapInArrow(_verify, "a long, b long")


def _rest_of_crowds(crowded: DataFrame, lines: DataFrame, links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between lines of large bands ``(node, key)`` that are in different components so far: all pairs that are alike."""
    placed = crowded.join(components(links, "line-parts"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    undone = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("size")).where("p <> q").select("key", (F.col("size") > DIRECT).alias("large"))
    rest = shared.saved(placed.join(undone, "key"), "crowds")
    lines = lines.select("node", "line")
    small = rest.where("not large").select("key", "node", "part")
    sketch = shared.saved(_with_sketch(lines.join(small, "node", "left_semi"), LONG).drop("line"), "crowd-sketches")
    small = small.join(sketch, "node")
    met = _end(small, "a").join(_end(small, "b"), "key").where("a < b and part_a <> part_b and 5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a").where(_may_be_alike(LONG))
    return _verified(met.select("a", "b").union(_met_on_shingles(rest.where("large").select("node", "part").distinct(), lines)).distinct(), lines)


def _met_on_shingles(rest: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of different parts that may be alike, by the rarest shingles of their lines."""
    held = shared.saved(lines.join(rest, "node").select("node", "part", "line"), "crowd-lines")
    counted = held.mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    often = np.zeros(BUCKETS, np.int64)
    for r in counted:
        often[r["bucket"]] = r["n"]
    prefixes = held.mapInArrow(_prefixes(often), "node long, part long, n int, place int, code long, " + ", ".join(f"{w} long" for w in SKETCH))
    # a is the lesser set and meets others by its first shingles only; the conditions are on both ends, as both are to be one shuffle
    first = "n_a <= n_b and if(n_a <= n_b, place_a, place_b) <= n_a - (8 * n_a + 8) div 9"
    left = "9 * (least(place_a, place_b) + least(n_a - place_a, n_b - place_b)) >= 4 * (n_a + n_b)"
    met = _end(prefixes, "a").join(_end(prefixes, "b"), "code").where(f"{first} and part_a <> part_b and 5 * n_a >= 4 * n_b and {left}").where(_may_be_alike())
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _bucket_counts(batches):
    """How many lines hold a shingle of each of ``BUCKETS`` buckets: as many rows a task, whatever its input."""
    often = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        often += np.bincount(_bucket(distinct_shingles(batch.column("line").to_pylist())[0]), minlength=BUCKETS)
    there = np.flatnonzero(often)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(often[there])], names=["bucket", "n"])


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(48)).astype(np.int64)


def _prefixes(often: np.ndarray):
    """The first shingles of each line in the order of their buckets' frequency: any order that all lines share is exact, and in this one shingles of a template come last.

    If two lines are alike, the first ones of the greater set, as many as it may lack and one more, hold one of the first ones of the lesser.
    """

    def task(batches):
        for batch in batches:
            code, line, n = distinct_shingles(batch.column("line").to_pylist())
            sketch = sketches(code, line, len(n), len(SKETCH))
            order = np.lexsort((code, often[_bucket(code)], line))
            place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
            first = place <= (n - (4 * n + 4) // 5)[line]
            code, line, place = code[order][first], line[first], place[first]
            node, part = (batch.column(x).take(pa.array(line)) for x in ("node", "part"))
            yield pa.RecordBatch.from_arrays(
                [node, part, pa.array(n[line], pa.int32()), pa.array(place, pa.int32()), pa.array(code.view(np.int64)), *map(pa.array, sketch[line].T)], names=["node", "part", "n", "place", "code", *SKETCH]
            )

    return task


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, line)``: the lines to drop of ``docs (row long, doc_id long, text string)``. Of each class the first by doc_id, row and line stays."""

    def occurrences(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            data, offsets = shared.text_buffer(batch.column("text"))
            rows, numbers, nodes = [], [], []
            for row, number, line in normal_lines(data, offsets):
                rows.append(row)
                numbers.append(number)
                nodes.append(xxh3_64_intdigest(line))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(numbers, pa.int32()), pa.array(np.array(nodes, np.uint64).view(np.int64))], names=["row", "doc_id", "line", "node"]
            )

    seen = docs.select("row", "doc_id", "text").mapInArrow(occurrences, "row long, doc_id long, line int, node long")
    at = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "row", "line")
    by_line = seen.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    nodes = components(shared.saved(line_links(docs), "line-links"), "line-classes")
    # a line that occurs once and is like no other needs no decision
    classed = by_line.join(nodes, "node", "left").where("n > 1 or component is not null").withColumn("class", F.coalesce("component", "node"))
    classed = shared.saved(classed.select("node", "class", "first"), "classed")
    # a class may hold a third of all lines: its kept line goes to each of several parts of it
    keeps = classed.groupBy("class").agg(F.min("first").alias("keep")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    decided = classed.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(keeps, ["class", "salt"]).select("node", "keep")
    return seen.join(decided, "node").where((F.col("keep.row") != F.col("row")) | (F.col("keep.line") != F.col("line"))).select("row", "doc_id", "line")


def with_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated and near-repeated lines dropped, all other columns as they were; n_chars, if there, follows the text.

    Blank lines always stay; a line without a shingle is compared with equal ones only. A null text stays null; repeated rows are documents of
    their own, so a second copy loses its lines; rows without doc_id come last in the order of who keeps a
    line; columns of any name pass through, as each row travels as one struct. Rows are numbered by
    their place in the scan, so ``docs`` must give the same rows in the same order each time, as files do;
    a row that comes back with another doc_id is an error.
    """
    rows = with_rows(docs)
    gone = removed_lines(rows).groupBy("row").agg(F.collect_set("line").alias("gone"), F.first("doc_id").alias("owner"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    moved = F.raise_error(F.lit("the documents came in another order; give a table that was written"))
    cut = F.when(F.col("gone").isNull(), F.col("text")).when(~F.col("owner").eqNullSafe(F.col("doc_id")), moved.cast("string")).otherwise(F.array_join(kept, "\n"))
    out = rows.join(gone, "row", "left").withColumn("cut", cut)
    columns = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c == "text":
            value = F.col("cut")
        elif c == "n_chars":
            value = F.when(F.col("gone").isNull(), value).otherwise(F.length("cut")).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return out.select(*columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines, how many stay, and the numbers of those that go."""
    rows = with_rows(shared.table(spark, sf_dir, "documents"))
    gone = removed_lines(rows).groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    counted = rows.select("row", "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    n = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return counted.join(gone, "row", "left").select("doc_id", "n_lines", (F.col("n_lines") - n).alias("n_kept"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))
