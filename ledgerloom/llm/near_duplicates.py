"""Near-duplicate classes by ProbMinHash.

1. Texts that are equal are one node, named by the MD5 of the text.
2. Each node's shingles of `SHINGLE` words, weighted by how often they occur,
   give a ProbMinHash signature; `BANDS` bands of `ROWS` registers are hashed.
3. Nodes that share a band are linked to the least node of the bucket, never
   with each other; connected components of these links are candidate groups.
4. Candidate groups are verified with the exact probability Jaccard similarity,
   in units of bounded size that return the parts they connect. First a group is
   cut into chunks and each chunk, with up to `PIVOTS` nodes that most buckets of
   the group lead to, is compared pair by pair. A group of one chunk is done.
   Parts of other groups meet again if texts of them share a shingle of their
   prefixes, which hold more than 1 - `LEAST` of a text's weight and begin with
   what is in fewest pivots: a pair at the threshold always does. Of the parts that
   meet, what is not in the largest one is compared with all of it. No link
   between different texts is lost, a large group of near copies costs in
   proportion to its size, and texts that share a template but not their own
   words meet nobody.
5. Connected components of the parts are the classes.

Probability Jaccard similarity equals plain Jaccard similarity where no shingle
occurs twice. A pair at the threshold `LEAST` shares one of the bands with a
probability of 1 - (1 - 0.8 ** 4) ** 20 = 0.99997.

Defined results: null counts as empty text. Texts without words are alike only
if they are equal. A text of fewer words than a shingle is one shingle. Equal
texts, so repeated rows too, are always in one class. The class is named by its
least doc_id (null if it has none but null). Other columns are not looked at.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textarrays as ta
from ledgerloom.llm.common import stage
from ledgerloom.llm.components import components, contracted

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
# nodes and shingles of one chunk of a candidate group
CHUNK_NODES = 256
CHUNK_SHINGLES = 1 << 20
# nodes of a group of several chunks that every chunk is compared with, at most
PIVOTS = 16


def shingles(chunk: ta.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of every distinct shingle, in order of text and hash, and the first of each text.

    A text of fewer words than a shingle has one shingle of all its words; a text without words has none.
    """
    words = ta.words(chunk)
    size = np.minimum(words.counts, SHINGLE)
    number = np.where(words.counts > 0, words.counts - size + 1, 0)
    text = np.repeat(np.arange(len(number)), number)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + words.first[text]
    h = ta.Sequences(words.hashes).stretch(begin, size[text])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])[: len(text)]
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(text)]]))
    return text[at], h[at], count, np.searchsorted(text[at], np.arange(len(number) + 1))


def _exponential(x: np.ndarray) -> np.ndarray:
    """Exponential variate of rate one from 64 random bits."""
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """ProbMinHash: per text and register the shingle that arrives there first.

    Every shingle is a Poisson process with its weight as rate; each arrival goes
    to a random register. A shingle stops once its next arrival is later than
    all registers of its text are filled. Two texts agree in a register with a
    probability equal to their probability Jaccard similarity.
    """
    first = np.full(n_texts * REGISTERS, np.inf)
    out = np.zeros(n_texts * REGISTERS, np.uint64)
    time, turn = np.zeros(len(h)), 0
    while len(h):
        turn += 1
        bits = ta.mix(h + np.uint64(turn * 0xD1342543DE82EF95 & (2**64 - 1)))
        time = time + _exponential(bits) / weight
        at = text * REGISTERS + ((ta.mix(bits) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        out[at[won]] = h[won]
        last = first.reshape(n_texts, REGISTERS).max(axis=1)
        stay = time < last[text]
        text, h, weight, time = text[stay], h[stay], weight[stay], time[stay]
    return out.reshape(n_texts, REGISTERS)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One hash per text and band of registers."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(signature), 0)
    for i in range(ROWS):
        h = ta.mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets given by sorted keys and positive weights.

    The sum over common keys i of 1 / sum over all keys j of max(x_j / x_i, y_j / y_i).
    """
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    u, v = x[i].astype(np.float64), y[j].astype(np.float64)
    ratio = u / v
    order = np.argsort(ratio)
    u, v, ratio = u[order], v[order], ratio[order]
    # keys with a larger ratio count by x, others by y
    above = np.concatenate([np.cumsum(u[::-1])[::-1], [0.0]]) + (x.sum() - u.sum())
    below = np.concatenate([[0.0], np.cumsum(v)]) + (y.sum() - v.sum())
    cut = np.searchsorted(ratio, ratio, "left")
    return float((1 / (above[cut] / u + below[cut] / v)).sum())


def node(text: str = "text") -> Column:
    """Name of a text: MD5, 16 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node, number of shingles, and the band hashes of every row, in one pass without a shuffle."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nodes = b.column("doc_id"), b.column("node")
            for chunk in ta.chunks(b.column("text").to_pylist()):
                n = len(chunk.first)
                text, h, count, edge = shingles(chunk)
                bands = band_hashes(signatures(text, h, count.astype(np.float64), n)).view(np.int64)
                # a text without words is in no bucket
                full = np.diff(edge) > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
                at = chunk.rows.start
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), nodes.slice(at, n), pa.array(np.diff(edge), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(bands[full].ravel()))],
                    ["doc_id", "node", "shingles", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), node().alias("node"), "text")
    return rows.mapInArrow(sketched, "doc_id long, node binary, shingles long, bands array<long>")


def candidate_groups(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label): components of the links from every node to the least node of each of its buckets; (low, n): these least nodes and their links."""
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    least = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    least = stage(least.select("bucket", "low", "n"), "near-buckets")
    links = members.join(least, "bucket").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return components(links), least.groupBy("low").agg(F.sum("n").alias("n"))


def _forest(sets: list[tuple[np.ndarray, np.ndarray]], left: range, right: range, parts: list[bytes]) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs of `left` and `right` at the threshold or above.

    Sets of the same part count as connected from the start.
    """
    lead: dict[bytes, int] = {}
    parent = [lead.setdefault(part, i) for i, part in enumerate(parts)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.array([w.sum() for _, w in sets], np.float64)
    plain = np.array([len(k) == w for (k, _), w in zip(sets, size, strict=True)])
    links = []
    step = 64
    for p in range(left.start, left.stop, step):
        for q in range(max(right.start, p) if left == right else right.start, right.stop, step):
            rows, columns = range(p, min(p + step, left.stop)), range(q, min(q + step, right.stop))
            keys = np.concatenate([sets[i][0] for i in (*rows, *columns)])
            names, place, times = np.unique(keys, return_inverse=True, return_counts=True)
            # keys of a single set are in no intersection
            column = np.cumsum(times > 1) - 1
            shared = times[place] > 1
            weight = np.concatenate([sets[i][1] for i in (*rows, *columns)])[shared]
            of = np.repeat(np.arange(len(rows) + len(columns)), [len(sets[i][0]) for i in (*rows, *columns)])[shared]
            dense = np.zeros((len(rows) + len(columns), int((times > 1).sum())), np.float32)
            dense[of, column[place[shared]]] = weight
            x, y = dense[: len(rows)], dense[len(rows) :]
            ones_x, ones_y = (x > 0).astype(np.float32), (y > 0).astype(np.float32)
            a, b = size[list(rows)][:, None], size[list(columns)][None, :]
            in_x, in_y = (x @ ones_y.T).astype(np.float64), (ones_x @ y.T).astype(np.float64)
            # no similarity is above the share of either side that is in common
            likely = np.minimum(in_x / np.maximum(a, 1), in_y / np.maximum(b, 1)) >= LEAST
            jaccard = in_x / np.maximum(a + b - in_x, 1)
            for i, j in np.argwhere(likely).tolist():
                u, v = rows[i], columns[j]
                if (left == right and u >= v) or root(u) == root(v):
                    continue
                same = jaccard[i, j] if plain[u] and plain[v] else similarity(*sets[u], *sets[v])
                if same >= LEAST:
                    parent[root(u)] = root(v)
                    links.append((u, v))
    return links


def _prefix(key: np.ndarray, count: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Shingles of a text up to more than 1 - `LEAST` of its weight, those in fewest pivots (`seen`) first.

    A pair at the threshold has `LEAST` of the weight of either text in common, so
    its first common shingle is in both prefixes: what comes before has less weight.
    """
    order = np.lexsort((key, seen))
    before = np.cumsum(count[order]) - count[order]
    return key[order[before <= (1 - LEAST) * count.sum() * (1 + 1e-9)]]


def _units(placed: DataFrame, keys: list[str], kind: str, close: Callable[[dict[str, list]], pa.RecordBatch]) -> DataFrame:
    """`close` of the rows of every unit, which `keys` name; a unit's rows come in order of `side`."""
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, "side")

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, None
        for b in batches:
            columns = {c: b.column(c) for c in b.schema.names}
            plain = {c: v.to_pylist() for c, v in columns.items() if c not in ("shingle", "count")}
            for r in range(len(b)):
                name = tuple(plain[c][r] for c in keys)
                if name != unit:
                    if rows:
                        yield close(rows)
                    unit, rows = name, {c: [] for c in (*plain, "sets")}
                for c, v in plain.items():
                    rows[c].append(v[r])
                # copies: the batch itself may go
                rows["sets"].append((columns["shingle"][r].values.to_numpy().view(np.uint64).copy(), columns["count"][r].values.to_numpy().copy()))
        if rows:
            yield close(rows)

    return placed.mapInArrow(closed, kind)


def _parts(placed: DataFrame) -> DataFrame:
    """(label, chunks, node, part, home, prefix) of the rows of units (label, i): parts are connected by links inside the unit.

    A part is named by its least pivot or, without one, by its least node.
    Groups of several chunks get the prefixes of their nodes.
    """

    def close(rows: dict[str, list]) -> pa.RecordBatch:
        # a node of repeated rows once
        once = sorted({x: i for i, x in enumerate(rows["node"])}.values())
        rows = {c: [v[i] for i in once] for c, v in rows.items()}
        nodes, sets, pivot = rows["node"], rows["sets"], rows["pivot"]
        n = len(nodes)
        lead = list(range(n))
        for u, v in _forest(sets, range(n), range(n), nodes):
            lead[_root(lead, u)] = _root(lead, v)
        roots = [_root(lead, i) for i in range(n)]
        name: dict[int, tuple[bool, bytes]] = {}
        for r, p, x in zip(roots, pivot, nodes, strict=True):
            name[r] = min(name.get(r, (True, b"\xff" * 17)), (not p, x))
        prefixes: list[np.ndarray | None] = [None] * n
        if rows["chunks"][0] > 1:
            known, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for (k, _), p in zip(sets, pivot, strict=True) if p]]), return_counts=True)
            for i, (key, count) in enumerate(sets):
                if rows["home"][i]:
                    at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                    times = np.where(known[at] == key, seen[at], 0) if len(known) else np.zeros(len(key), np.int64)
                    prefixes[i] = _prefix(key, count, times).view(np.int64)
        out = [rows["label"], rows["chunks"], nodes, [name[r][1] for r in roots], rows["home"], prefixes]
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["label", "chunks", "node", "part", "home", "prefix"])

    return _units(placed, ["label", "i"], "label binary, chunks int, node binary, part binary, home boolean, prefix array<long>", close)


def _root(lead: list[int], i: int) -> int:
    while lead[i] != i:
        lead[i] = lead[lead[i]]
        i = lead[i]
    return i


def _linked(placed: DataFrame) -> DataFrame:
    """(a, b): links between parts that texts of side 0 and of side 1 of a unit (label, i, j) make."""

    def close(rows: dict[str, list]) -> pa.RecordBatch:
        parts, left = rows["part"], rows["side"].count(0)
        links = _forest(rows["sets"], range(left), range(left, len(parts)), parts)
        return pa.RecordBatch.from_arrays([pa.array([parts[p[k]] for p in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return _units(placed, ["label", "i", "j"], "a binary, b binary", close)


def _chunks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / CHUNK_NODES), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")


def verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the classes of the nodes of candidate groups; `links` says how many links lead to a node."""
    sized = stage(nodes.select("node", "first", "shingles").join(groups, "node").join(links.withColumnRenamed("low", "node"), "node", "left"), "near-sized")
    totals = sized.groupBy("label").agg(_chunks(F.count(F.lit(1)), F.sum("shingles")).alias("chunks"))
    totals = stage(totals, "near-totals")
    # of each slice of a large group the node with most links
    several = sized.filter("n IS NOT NULL").join(totals.filter("chunks > 1"), "label")
    pivots = several.groupBy("label", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slice")).agg(F.max(F.struct("n", "node")).alias("most"))
    pivots = pivots.select(F.col("most.node").alias("node"), F.lit(True).alias("pivot"))
    wanted = sized.join(totals, "label").join(pivots, "node", "left")
    wanted = wanted.withColumns({"pivot": F.coalesce("pivot", F.lit(False)), "chunk": F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")})
    wanted = stage(wanted.select(F.col("first").alias("_first"), F.col("node").alias("_node"), "label", "chunks", "chunk", "pivot", "shingles"), "near-wanted")
    rows = docs.select(F.col("doc_id").cast("long"), node().alias("node"), "text")
    # the wanted nodes grow with the documents: never a broadcast, the same plan at every size
    rows = rows.join(wanted.hint("merge"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    kept = ["node", "label", "chunks", "chunk", "pivot"]

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in ta.chunks(b.column("text").to_pylist()):
                text, h, count, edge = shingles(chunk)
                n, at = len(chunk.first), chunk.rows.start
                lists = [pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(v)) for v in (h.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, n) for c in kept], *lists], [*kept, "shingle", "count"])

    kind = "node binary, label binary, chunks int, chunk int, pivot boolean, shingle array<long>, count array<int>"
    # repeated rows give the same node again, and a node does no harm twice
    sets = stage(rows.select("text", *kept).mapInArrow(as_sets, kind), "near-sets")
    # every chunk with the pivots of its group
    abroad = sets.filter("pivot AND chunks > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("i <> chunk")
    placed = sets.withColumns({"i": F.col("chunk"), "home": F.lit(True)}).unionByName(abroad.withColumn("home", F.lit(False)))
    placed = placed.select("label", "i", F.lit(0).alias("side"), "chunks", "node", "pivot", "home", "shingle", "count")
    found = stage(_parts(placed), "near-parts")
    # one chunk: all pairs are compared. Several: a pivot may be in another part in each chunk
    linked = found.filter("chunks > 1 AND node <> part").join(pivots.select("node"), "node", "left_semi")
    linked = linked.select("label", F.col("node").alias("a"), F.col("part").alias("b"), F.lit(False).alias("open")).distinct()
    # at most `PIVOTS` nodes a group: all links of a group meet in one partition
    same = contracted(linked.repartition("label")).select(F.col("a").alias("part"), F.col("b").alias("whole"))
    same = stage(same, "near-same")
    parts = found.filter("chunks > 1 AND home").select("label", "node", "part", "prefix").join(same, "part", "left")
    parts = stage(parts.withColumn("part", F.coalesce("whole", "part")).drop("whole"), "near-whole")
    labels = found.filter("home").select("node", "part").join(same, "part", "left").select("node", F.coalesce("whole", "part").alias("part"))
    again = _linked_again(sets, parts, wanted)
    if again is None:
        return labels.withColumnRenamed("part", "label")
    classes = components(again).withColumnRenamed("node", "part")
    return labels.join(classes, "part", "left").select("node", F.coalesce("label", "part").alias("label"))


def _linked_again(sets: DataFrame, parts: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """(a, b): links between different parts of groups of several chunks; None if there are none to look for.

    Only texts that share a shingle of their prefixes can be alike. Parts that do
    are put together, again by links to the least one and components; inside them,
    what is not in the largest part meets all others.
    """
    shared = parts.select("label", "part", F.explode("prefix").alias("key"))
    least = shared.groupBy("label", "key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    least = stage(least.select("label", "key", "low"), "near-prefixes")
    if least.isEmpty():
        return None
    meet = shared.join(least, ["label", "key"]).filter("part <> low").select(F.col("part").alias("a"), F.col("low").alias("b"))
    near = components(meet).select(F.col("node").alias("part"), F.col("label").alias("near"))
    rows = parts.select("node", "part").join(near, "part").join(wanted.select(F.col("_node").alias("node"), "shingles"), "node")
    rows = stage(rows, "near-rows")
    sizes = rows.groupBy("near", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("s"))
    main = sizes.groupBy("near").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "part", "s")).alias("most"))
    rests = _chunks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s"))
    main = stage(main.select("near", F.col("most.part").alias("main"), rests.alias("rests"), _chunks(F.col("n"), F.col("s")).alias("chunks")), "near-main")
    rest = F.when(F.col("part") != F.col("main"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests")).cast("int"))
    chunk = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")
    again = rows.join(main, "near").select("node", "near", "part", "rests", "chunks", rest.alias("rest"), chunk.alias("chunk"))
    rows = sets.select("node", "shingle", "count").join(stage(again, "near-again").hint("merge"), "node")
    columns = [F.col("near").alias("label"), "i", "j", "side", "part", "shingle", "count"]
    left = rows.filter("rest IS NOT NULL").withColumns(
        {"i": F.col("rest"), "j": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "side": F.lit(0)}
    )
    right = rows.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("rests") - 1)), "j": F.col("chunk"), "side": F.lit(1)})
    return stage(_linked(left.select(*columns).unionByName(right.select(*columns))), "near-links")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node), and nodes (node, first: least doc_id, class: name of the class, kept: the class's first node). Both are staged."""
    rows = stage(sketches(docs), "near-sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("shingles").alias("shingles"), F.any_value("bands").alias("bands"))
    nodes = stage(nodes, "near-nodes")
    groups, links = candidate_groups(nodes)
    labels = stage(verified(docs, nodes, groups, links), "near-labels")
    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # the least doc_id leads, a null one comes last
    leader = F.min(F.struct(F.col("first").isNull().alias("missing"), "first", "node")).alias("leader")
    leaders = stage(named.groupBy("label").agg(leader), "near-leaders")
    out = named.join(leaders, "label").select(
        "node", "first", F.col("leader.first").alias("class_id"), (F.col("leader.node") == F.col("node")).alias("kept")
    )
    return rows.select("doc_id", "node"), stage(out, "near-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and copy (another document of the class comes first) of every row."""
    rows, nodes = classes(docs)
    joined = rows.join(nodes, "node")
    return joined.select("doc_id", "class_id", (~(F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first")))).alias("copy"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of `docs` of each class: one with its least doc_id. All columns stay."""
    _, nodes = classes(docs)
    kept = nodes.filter("kept").select(F.col("node").alias("_node"))
    # copies of a text meet before the shuffle
    one = docs.groupBy(node().alias("_node")).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("_row"))
    return one.join(kept.hint("merge"), "_node", "left_semi").select("_row.*")
