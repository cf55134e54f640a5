"""Exact n-gram Jaccard self-join and its components, with set-relation skipping.

A document's set is its distinct word n-grams, as 62-bit hashes.  Sets that link share part of their prefixes in
any one global order, so the join works on prefixes and verifies what is left on whole sets:

1. Frequent n-grams are counted and put last in the global order; the others are ordered by hash.  The order
   is only a matter of speed, any order is exact.
2. Every document gives its set's size, a 128-bit signature and its prefix.  Documents with the same signature
   are one set from here on: copies are never paired.
3. Stars.  A set's first ``STAR`` n-grams name hubs, of each the set with the most equal documents (a group of near
   copies mostly has its origin there); pairs (set, hub) that agree on two of them are verified on whole sets.  That takes at most STAR pairs a set, however large a group of near
   copies is.  A set that links to its hub takes over the hub's answers: in what follows, all sets of a
   component have one answer, and only links between components are looked for.
4. Index lists.  For each n-gram of the prefixes whose list holds more than one component (one aggregation tells),
   pairs across components are formed.  A list is ordered by set size and cut into blocks; with the sizes and
   positions of a block as bounds, a set skips every block that cannot hold enough common n-grams, and the pairs
   left are bounded each, by position and by the parity bitmaps of the two whole sets.  Lists with the same largest
   component make a unit, so a pair is counted there over all lists that it shares and named once.  The matches of a
   pair, over all units, must reach what the two sizes ask for given that both prefixes have been seen whole.  A
   unit of more rows than a cell may have is dealt to cells by parts of its sets: each part of the largest component
   meets each part of the rest, and the parts of the rest meet each other, so no task gets an unbounded unit.
   Step 4 runs twice.  At first, of any two components of which one is large, only the likeliest pair is named and
   verified: near copies that miss their hub mostly come to their group by it.  The second time all pairs of components
   that are still apart are named.
5. The pairs left are verified on whole sets, the likeliest of each set first; pairs that these links put into one
   component are answered.  The components of all links are the result.

``similar_pairs`` is the join itself: every link between different sets, by step 4 with each set as a component of its
own, and the membership of documents in sets.

N-grams are compared as 62-bit hashes, and sets that agree in size and a 128-bit signature count as one; a text
pair is wrongly linked only where such hashes collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common
from tabulon.llm.components import connected

#: Words of an n-gram of the query; links of the query need 85 in 100.
WORDS, PERCENT = 4, 85
STAR = 6
#: Common prefix n-grams that a pair needs at least; the prefix is longer by that.
ELL = 3
#: Rows of each side of a cell (more only where a unit has over (UNIT / GROWTH) ** 2 rows, by the square root of them,
#: so that the copies of rows in its cells do not grow with its square), and rows of a skip block.
UNIT, GROWTH, BLOCK = 2000, 10, 32
#: n-grams that go last in the order: at most so many, in at least LOCAL texts of a block somewhere.
HEAVY, LOCAL = 100_000, 8
#: Sets of a component in a cell from which on a set beside it meets its likeliest partner there first.
CROWD = 8
#: Bits of a set's parity bitmap.
BITS = 512
#: Ids of documents to verify that are sent to every executor; beyond that they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs that the kernel of the lists makes at once, pairs that it holds before it names them, and rows that it holds.
PAIRS, NAMED, HELD = 1 << 18, 1 << 20, 200_000
#: Bytes of text that are cut into n-grams at once; the arrays take about 100 bytes for each.
TEXT = 1 << 20
TOP = np.int64(1) << 62


def need(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b: the ceiling of percent (a + b) / (100 + percent)."""
    return -((-percent * (a + b)) // (100 + percent))


def grams(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text in ascending order, and where each text's begin."""
    data, at = common.flat_utf8(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    b, e = common.runs(~common.SPACE[data], at)
    n = len(at) - 1
    owner = np.searchsorted(at, b, side="right") - 1
    count = np.bincount(owner, minlength=n)
    h = common.run_hashes(data, b, e)
    first = np.append(0, np.cumsum(count))
    place = np.arange(len(h)) - np.repeat(first[:-1], count)
    left = np.repeat(count, count) - place  # words from here to the end of the text
    begins = np.flatnonzero((left >= words) | (place == 0))
    size = np.minimum(left[begins], words)
    with np.errstate(over="ignore"):
        value = common.mix64(size.astype(np.uint64) + np.uint64(0x51ED270B))
        for k in range(words):
            more = size > k
            value[more] = common.mix64(value[more] * np.uint64(3) + h[begins[more] + k])
    value = (value >> np.uint64(2)).astype(np.int64)
    own = owner[begins]
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.append(0, np.cumsum(np.bincount(own, minlength=n)))


def _owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The n-grams that go last, most frequent at the end; counted over all texts.

    An n-gram is counted where at least LOCAL texts of a block share it, so one in more than LOCAL texts a
    block on average is never missed.  At most HEAVY rows reach the driver: a histogram of the counts, of some hundred
    rows, tells which.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, n = np.unique(grams(batch.column(1), words)[0], return_counts=True)
        hot = n >= LOCAL
        return pa.record_batch([pa.array(value[hot]), pa.array(n[hot])], names=["gram", "n"])

    counted = common.written(common.map_text(docs, kernel, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "hot-grams")
    level = F.floor(F.log2("n") * 8).cast("int")
    left, wanted = HEAVY, F.lit(False)
    # from the most frequent level down; of the level that does not fit, a share by hash
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["level"]):
        fits = r["c"] <= left
        here = level == r["level"]
        wanted = wanted | (here if fits else here & (F.col("gram") < int(0.9 * left / r["c"] * TOP)))
        left -= r["c"]
        if not fits:
            break
    rows = counted.filter(wanted).toPandas().sort_values(["n", "gram"])
    common.drop(counted)
    return rows["gram"].to_numpy(dtype=np.int64)


def _ordered(value: np.ndarray, first: np.ndarray, by: np.ndarray, place: np.ndarray) -> np.ndarray:
    """n-grams as keys of the global order, ascending in each text: frequent ones above all hashes."""
    if not len(by) or not len(value):
        return value
    at = np.minimum(np.searchsorted(by, value), len(by) - 1)
    hot = by[at] == value
    keys = np.where(hot, TOP + place[at], value)
    return keys[np.lexsort((keys, _owners(first)))]


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each set, from two sums of mixed members."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)):
            upto = np.append(np.uint64(0), np.cumsum(common.mix64(value.astype(np.uint64) * np.uint64(2) + np.uint64(salt))))
            out[:, k] = upto[first[1:]] - upto[first[:-1]]
    return out


def parities(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BITS bits for each set: bit k is the parity of how many members hash to k.  Two sets differ in at least as
    many members as their bits differ, so their overlap is at most half of (a + b - differing bits)."""
    n = len(first) - 1
    bit = (common.mix64(value.astype(np.uint64) + np.uint64(77)) & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount(_owners(first) * BITS + bit, minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(bool), axis=1)


def _fixed(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _lists(value: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(value))


def prefixes(docs: DataFrame, words: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """(doc_id, n, sig, bits, prefix) of every document."""
    place = np.argsort(heavy, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((heavy[place], place))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, first = grams(batch.column(1), words)
        n = np.diff(first)
        keys = _ordered(value, first, *sent.value)
        length = np.minimum(n, n - -((-percent * n) // 100) + ELL)
        inside = np.arange(len(keys)) - np.repeat(first[:-1], n) < np.repeat(length, n)
        return pa.record_batch([batch.column(0), pa.array(n), _fixed(signatures(value, first).view(np.uint8)), _fixed(parities(value, first)), _lists(keys[inside], length)], names=["doc_id", "n", "sig", "bits", "prefix"])

    return common.map_text(docs, kernel, "doc_id long, n long, sig binary, bits binary, prefix array<long>", TEXT)


def whole_sets(docs: DataFrame, words: int, sets: DataFrame) -> DataFrame:
    """(id, grams) for rows (id, sig, doc_id) of sets; only texts of those documents are read into sets."""
    ids = sets.select(F.col("doc_id").alias("__id")).distinct()
    ids = F.broadcast(ids) if sets.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, first = grams(batch.column(1), words)
        return pa.record_batch([_fixed(signatures(value, first).view(np.uint8)), _lists(value, np.diff(first))], names=["sig", "grams"])

    found = common.map_text(texts, kernel, "sig binary, grams array<long>", TEXT).join(sets.select("id", "sig"), "sig")
    # rows that repeat an id with the same text give a set again
    return found.groupBy("id").agg(F.first("grams").alias("grams"))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that link, by their whole sets; b is the side that repeats."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = common.written(sets.join(ends, "id", "left_semi").select("id", "sig", "doc_id"), "wanted")
    full = common.written(whole_sets(docs, words, wanted), "whole-sets")
    one = pairs.join(full.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    two = one.join(full.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    out = common.written(two.filter(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b"), "verified")
    common.drop(wanted, full)
    return out


#: Columns of a row of the kernel of the lists, before its bitmap.
ROW = ("top", "i", "j", "gram", "side", "id", "n", "pos", "comp")


def _cuts(x: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    """Flags of the rows where one of the named columns changes."""
    new = np.ones(len(x["gram"]), bool)
    new[1:] = np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in names])
    return new


def list_pairs(x: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the lists of x that positions and sizes allow, in portions of about PAIRS.

    A list is the rows of one (top, i, j, gram), ascending in n.  Pairs are of different components and opposite
    sides (side 2: any).
    """
    new = _cuts(x, ("top", "i", "j", "gram"))
    cell = np.cumsum(new) - 1
    bounds = np.append(np.flatnonzero(new), len(new))
    rank = np.arange(len(new)) - bounds[cell]
    # skip blocks: BLOCK rows of one list, with the least and largest size and position
    cut = new | (rank % BLOCK == 0)
    head = np.flatnonzero(cut)
    block = np.cumsum(cut) - 1
    tail = np.append(head[1:], len(new))
    n_low, n_high = x["n"][head], x["n"][tail - 1]
    p_low, p_high = np.minimum.reduceat(x["pos"], head), np.maximum.reduceat(x["pos"], head)
    last_block = block[bounds[cell + 1] - 1]
    many = last_block - block + 1
    upto = np.cumsum(many)
    start = 0
    while start < len(many):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS // BLOCK, side="right")))
        row = np.repeat(np.arange(start, stop), many[start:stop])
        k = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(many[start:stop]))[:-1], many[start:stop])
        blk = block[row] + k
        n, p = x["n"][row], x["pos"][row]
        top = np.minimum(n - p, n_high[blk] - p_low[blk]) + np.minimum(p, p_high[blk])
        fits = (n_low[blk] * percent <= n * 100) & (top >= need(n, np.maximum(n_low[blk], n), percent))
        row, blk = row[fits], blk[fits]
        size = tail[blk] - head[blk]
        a = np.repeat(row, size)
        b = np.arange(len(a)) - np.repeat(np.append(0, np.cumsum(size))[:-1], size) + np.repeat(head[blk], size)
        good = (b > a) & (x["comp"][a] != x["comp"][b]) & ((x["side"][a] != x["side"][b]) | (x["side"][a] == 2))
        a, b = a[good], b[good]
        na, nb, pa_, pb = x["n"][a], x["n"][b], x["pos"][a], x["pos"][b]
        good = np.minimum(na - pa_, nb - pb) + np.minimum(pa_, pb) >= need(na, nb, percent)
        yield a[good], b[good]
        start = stop


def unit_hits(x: dict[str, np.ndarray], bits: dict[str, np.ndarray], percent: int, crowd: int = 0) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, hits) of the rows of some units: each pair once a unit, with its matches over all lists there.

    ``bits`` are (id, bits) of sets; a pair of which one is not there passes without that bound.  With ``crowd``, only the
    pair with the most matches of each two components is named, and only where one of them has so many sets here.
    """
    if not len(x["gram"]):
        return
    unit = np.cumsum(_cuts(x, ("top", "i", "j"))) - 1
    ids, row, of = np.unique(x["id"], return_index=True, return_inverse=True)
    n, m = x["n"][row], np.int64(len(ids))
    at = np.minimum(np.searchsorted(bits["id"], ids), max(0, len(bits["id"]) - 1))
    has = bits["id"][at] == ids if len(bits["id"]) else np.zeros(len(ids), bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(back, weights=np.concatenate([c for _, c in held]), minlength=len(key)).astype(np.int64)

    comp = np.unique(x["comp"][row], return_inverse=True)[1]
    sizes = np.bincount(comp)

    def batch(key: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
        low, high = key // m % m, key % m
        if crowd:
            one, two = np.minimum(comp[low], comp[high]), np.maximum(comp[low], comp[high])
            order = np.lexsort((key, -hits, two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            order = order[new]
            order = order[np.maximum(sizes[one[order]], sizes[two[order]]) >= crowd]
            low, high, hits = low[order], high[order], hits[order]
        return pa.record_batch([pa.array(v) for v in (ids[low], ids[high], n[low], n[high], hits)], names=["a", "b", "na", "nb", "hits"])

    for a, b in list_pairs(x, percent):
        low, high = np.minimum(of[a], of[b]), np.maximum(of[a], of[b])
        key, hits = np.unique((unit[a] * m + low) * m + high, return_counts=True)
        low, high = key // m % m, key % m
        apart = np.zeros(len(key), np.int64)
        for k in range(0, len(key), PAIRS // 8):
            c, d = low[k : k + PAIRS // 8], high[k : k + PAIRS // 8]
            known = has[c] & has[d]
            c, d = at[c[known]], at[d[known]]
            apart[k : k + PAIRS // 8][known] = np.bitwise_count(bits["bits"][c] ^ bits["bits"][d]).sum(axis=1, dtype=np.int64)
        good = n[low] + n[high] - apart >= 2 * need(n[low], n[high], percent)
        held.append((key[good], hits[good]))
        if sum(len(k) for k, _ in held) > NAMED:
            held = [merged()]
            if len(held[0][0]) > NAMED // 2:
                yield batch(*held[0])
                held = []
    if held:
        yield batch(*merged())


def match_lists(rows: DataFrame, percent: int, crowd: int = 0) -> DataFrame:
    """(a, b, na, nb, hits) from units of index lists: rows (top, i, j, gram, side, id, n, pos, comp, bits).

    Rows of gram -1 bring a set's bitmap to a unit.  Units must be whole in a partition and ordered by
    (top, i, j, gram, n).  A unit is held up to HELD rows and then goes on from its next list, so a pair may come
    in portions, which are added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        bits = {"id": np.zeros(0, np.int64), "bits": np.zeros((0, BITS // 64), np.uint64)}

        def done(x: dict[str, np.ndarray], more: bool) -> Iterator[pa.RecordBatch]:
            nonlocal bits
            yield from unit_hits(x, bits, percent, crowd)
            if not more:  # the bitmaps go when no unit is open
                bits = {c: v[:0] for c, v in bits.items()}

        for batch in batches:
            if not len(batch):
                continue
            x = {c: np.asarray(batch.column(k)).astype(np.int64) for k, c in enumerate(ROW)}
            mark = x["gram"] < 0
            if mark.any():
                packed = pc.filter(batch.column(len(ROW)), pa.array(mark)).to_pylist()
                own = {"id": x["id"][mark], "bits": np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), BITS // 64)}
                room = max(0, HELD - len(bits["id"]))  # beyond it pairs pass without this bound
                every = np.concatenate([bits["id"], own["id"][:room]])
                ids, first = np.unique(every, return_index=True)
                bits = {"id": ids, "bits": np.concatenate([bits["bits"], own["bits"][:room]])[first]}
            x = {c: v[~mark] for c, v in x.items()}
            if held is not None:
                x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
            if not len(x["gram"]):
                continue
            # the last unit may go on in the next batch
            names = ("top", "i", "j") if len(x["gram"]) <= HELD else ("top", "i", "j", "gram")
            cut = int(np.flatnonzero(_cuts(x, names))[-1])
            held = {c: v[cut:] for c, v in x.items()}
            if cut:
                yield from done({c: v[:cut] for c, v in x.items()}, True)
        if held is not None:
            yield from done(held, False)

    found = common.in_batches(rows).mapInArrow(run, "a long, b long, na long, nb long, hits long")
    return found.groupBy("a", "b", "na", "nb").agg(F.sum("hits").alias("hits"))


def units(shared: DataFrame, sets: DataFrame, crowd: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``match_lists``, and the two written tables that they read, from the postings (gram, id, n, pos, comp) of lists with several components.

    The lists with the same largest component, ``top``, make one unit, as near copies share many lists: a pair
    then meets in few units.  A unit of more than two UNIT rows is dealt to cells: the sets of the largest component
    and the others are cut into parts by id, the same in all lists of the unit, and two parts meet in one cell, so a
    pair is named once there too.  ``sets`` have (id, bits); each bitmap goes once to a cell.  With ``crowd`` only lists
    with so many sets of one component are placed.
    """
    tops = shared.groupBy("gram", "comp").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("size"))
    tops = tops.filter(F.col("m.c") >= crowd) if crowd else tops
    tops = common.written(tops.select("gram", F.col("m.comp").alias("top"), F.col("m.c").alias("c"), "size"), "tops")
    large = tops.groupBy("top").agg(F.sum("c").alias("own"), F.sum(F.col("size") - F.col("c")).alias("rest")).filter(F.col("own") + F.col("rest") > 2 * UNIT)
    side = F.greatest(F.lit(UNIT), GROWTH * F.sqrt(F.col("own") + F.col("rest")))
    large = large.select("top", *(F.ceil(F.col(c) / side).cast("int").alias(n) for c, n in (("own", "parts"), ("rest", "rests"))))
    placed = common.written(shared.join(tops.join(large, "top", "left").select("gram", "top", "parts", "rests"), "gram"), "placed")
    own, other = F.pmod(F.xxhash64("id"), "parts").cast("int"), F.pmod(F.xxhash64("id"), "rests").cast("int")

    def cell(i, j, side):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    zero, one, any_ = F.lit(0), F.lit(1), F.lit(2)
    inside = F.transform(F.sequence(zero, F.col("rests") - 1), lambda k: cell(-1 - own, k, zero))
    beside = F.transform(F.sequence(zero, F.col("parts") - 1), lambda k: cell(-1 - k, other, one))
    among = F.transform(F.sequence(zero, F.col("rests") - 1), lambda k: cell(F.least(k, other), F.greatest(k, other), F.when(k == other, any_).when(other < k, zero).otherwise(one)))
    whole = F.array(cell(zero, zero, any_))

    def dealt(rows: DataFrame) -> DataFrame:
        cells = F.when(F.col("parts").isNull(), whole).when(F.col("comp") == F.col("top"), inside).otherwise(F.concat(beside, among))
        return rows.withColumn("cell", F.explode(cells)).select("cell.i", "cell.j", "cell.side", *[c for c in rows.columns if c not in ("parts", "rests")])

    postings = dealt(placed).withColumn("bits", F.lit(None).cast("binary"))
    maps = dealt(placed.select("top", "id", "comp", "parts", "rests").distinct()).join(sets.select("id", "bits"), "id")
    maps = maps.withColumns({"gram": F.lit(-1).cast("long"), "n": F.lit(0).cast("long"), "pos": F.lit(0)})
    rows = postings.select(*ROW, "bits").unionByName(maps.select(*ROW, "bits"))
    return rows.repartition("top", "i", "j").sortWithinPartitions("top", "i", "j", "gram", "n"), tops, placed


def sets_of(given: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables from rows (doc_id, text): the prefixes of all rows, the distinct sets (id, sig, n, doc_id,
    copies), and the index (id, n, copies, bits, prefix) of sets that may link with others."""
    if need(ELL, ELL + 1, percent) <= ELL:
        raise ValueError(f"{percent} percent is too low: sets of up to {ELL} n-grams would link with larger ones")
    rows = common.written(prefixes(given, words, percent, frequent(given, words)), "prefixes")
    classes = rows.filter("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    sets = common.written(classes.select(F.monotonically_increasing_id().alias("id"), "sig", "n", "doc_id", "copies"), "sets")
    # the prefix of one row of each set; sets of up to ELL n-grams link with equal sets only
    firsts = rows.filter(f"n > {ELL}").select("sig", F.col("doc_id").alias("d"), "bits", "prefix")
    met = sets.join(firsts, "sig").filter(F.col("d").eqNullSafe(F.col("doc_id"))).dropDuplicates(["id"])
    return rows, sets, common.written(met.select("id", "n", "copies", "bits", "prefix"), "index")


def candidates(full: DataFrame, percent: int, crowd: int = 0) -> DataFrame:
    """(a, b, hits), a < b, of sets (id, n, comp, bits, prefix) in different components that may link; written.

    With ``crowd`` only the likeliest pair of each two components of which one is so large; then some may be left out.
    """
    postings = full.select("id", "n", "comp", F.posexplode("prefix").alias("pos", "gram"))
    lists = postings.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("gram")
    shared = common.written(postings.join(lists.select("gram"), "gram", "left_semi").select("gram", "id", "n", "pos", "comp"), "shared")
    rows, *made = units(shared, full, crowd)
    hits = match_lists(rows, percent, crowd)
    seen = lambda n: F.col(n) - F.least(F.col(n), F.floor(F.col(n) * (100 - percent) / 100) + ELL)  # noqa: E731  n-grams after the prefix
    overlap = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    enough = F.col("hits") >= F.greatest(F.lit(ELL), overlap - F.greatest(seen("na"), seen("nb")))
    found = common.written(hits.filter(enough).select("a", "b", "hits"), "candidates")
    common.drop(shared, *made)
    return found


def similar_pairs(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join: members (doc_id, n_shingles, set_id) of every document, and every link (a, b), a < b, of different sets.

    Documents of one set are equal in their n-grams and link among each other; they are not expanded to pairs.  A
    document without words has a null set_id.  Otherwise as ``similar_components``; the links of a group of R
    different near copies are up to R * R / 2 rows, which is what a join of them is.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, sets, index = sets_of(given, words, percent)
    found = candidates(index.select("id", "n", F.col("id").alias("comp"), "bits", "prefix"), percent)
    links = verified(found.select("a", "b"), sets, given, words, percent)
    members = rows.filter("n > 0").join(sets.select("sig", F.col("id").alias("set_id")), "sig").select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    return members.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("set_id"))), links


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are what white space (space, bytes 9 to 13) leaves, A-Z lower-cased.  A text of fewer than ``words``
    words has its whole sequence as its only n-gram; a null text, or one without words, has an empty set, which
    links with nothing, so its component is itself.  Repeated rows are equal sets: they link.  component_id is
    the least id of the component, null ids left aside; a component of null ids only has a null one.  Ids are
    whole numbers; a text id is an error or null, by the session's casts.  ``percent`` is over 75.  An empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, sets, index = sets_of(given, words, percent)

    keys = index.select("id", "n", "copies", F.explode(F.slice("prefix", 1, STAR)).alias("gram"))
    hubs = keys.groupBy("gram").agg(F.max(F.struct("copies", (-F.col("id")).alias("minus"), "id", "n")).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("gram", F.col("hub.id").alias("b"), F.col("hub.n").alias("nb"))
    near = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent
    stars = keys.join(hubs, "gram").filter((F.col("id") != F.col("b")) & near).groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("c")).filter("c >= 2").select("a", "b")
    stars = common.written(stars, "stars")
    links = verified(stars, sets, given, words, percent)
    roots = connected(links)

    common.drop(stars)
    # a set beside a large component: first its likeliest partner there alone, then all partners where that was no link
    for crowd in (CROWD, 0):
        full = index.join(roots, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("root", "id").alias("comp"), "bits", "prefix")
        full = common.written(full, "components")
        found = candidates(full, percent, crowd)
        common.drop(full)
        if crowd:
            links = links.unionByName(verified(found.select("a", "b"), sets, given, words, percent))
            roots = connected(links)
            common.drop(found)
    common.drop(index)
    # the likeliest partner of each set first; what then is within a component needs no more answers
    likely = [found.groupBy(one).agg(F.max(F.struct("hits", other)).alias("m")).select(one, F.col(f"m.{other}").alias(other)).select("a", "b") for one, other in (("a", "b"), ("b", "a"))]
    first = common.written(likely[0].unionByName(likely[1]).distinct(), "likely")
    links = links.unionByName(verified(first, sets, given, words, percent))
    roots = connected(links)
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    open_ = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    rest = common.written(open_.filter(apart).select("a", "b").join(first, ["a", "b"], "left_anti"), "rest")
    common.drop(found, first)
    links = links.unionByName(verified(rest, sets, given, words, percent))
    roots = connected(links)

    named = sets.join(roots, F.col("id") == F.col("node"), "left").select("sig", "doc_id", F.coalesce("root", "id").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_sig = named.join(least, "comp").select("sig", "component_id")
    linked = rows.filter("n > 0").join(of_sig, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents of ``docs`` that stay: of each component the one with the least doc_id.

    Rows with a null id cannot be told apart, so they stay.  An id that repeats stays where one of its rows does.
    """
    found = common.written(similar_components(docs, words, percent).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "near")
    gone = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept")
    return common.without(docs, gone.select("doc_id"), "doc_id")


def op2(spark, sf_dir: str) -> DataFrame:
    return similar_components(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh
  FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.sh
"""
