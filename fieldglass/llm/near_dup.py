"""Near-duplicate groups by an LSH forest over MinHash signatures.

Documents with equal shingle sets share a node (a 128-bit digest of the set). Each node gets `TREES` sorted orders of
its signature, each beginning at another place of it. Range partitioning on (first DEPTH values, the rest) lays a
tree's order out over tasks, however large a region of equal beginnings is. In each order a node meets the
neighbours that share at least the first DEPTH values, nearest (longest common prefix) first, `WINDOW` at most. A run of up to WINDOW
equal beginnings stays in one task, so all of its pairs are met. Longer runs are dense: range partitioning spreads them, sorting by all
remaining values makes the window reach deeper prefixes, and round 3 finds what the window misses.

Round 1 takes for each node the nearest neighbour on either side whose signature agrees well enough, confirms these pairs on
full sets and joins them to components. Round 2 looks at the nodes that agree with one of another component, and gives these a
signature of FINE values. Every pair in the window whose components differ and whose long signatures agree too is confirmed as well.
So neither copies nor a text's many loose variants become all pairs.

Round 3 joins the nodes of dense runs by shingles. In one order of all shingles (about from rare to frequent), two sets of similarity 0.75
share one among the first 1/7 of the smaller and the first 1/4 of the larger, whatever the order is, and the places of the first they share bound their overlap.
Shingles that a single component has are left out; nodes of a shingle's largest component meet those of others only, and the nodes of a
frequent shingle are dealt out in blocks. So no window bounds which links between components are found.

At similarity 0.75 a tree brings two nodes of a sparse region together with probability 0.56; that all 16 miss has odds of 2e-6.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import pieces, shingle_sets, staged, to_all

TREES, STRIDE, DEPTH, WINDOW, WIDTH, SEED = 16, 6, 2, 512, 5, 20
VALUES = TREES * STRIDE
#: Similarity that links, in hundredths, and the equal values of a signature from which a pair is looked at (4.4 deviations below 0.75; the same of FINE values).
LINK, AGREE = 75, 53
FINE = 1024
#: Slots of the shingle counts that order the shingles, and nodes of a block of a shingle's nodes.
SLOTS, BLOCK = 1 << 20, 1024
FINE_AGREE = int(FINE * (LINK / 100 - 4.4 * (LINK / 100 * (1 - LINK / 100) / FINE) ** 0.5))

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 2**63, VALUES + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES + FINE, dtype=np.uint64)


def signatures(sets: list[np.ndarray], first: int = 0, values: int = VALUES) -> np.ndarray:
    """The MinHash values of each non-empty set, as rows of uint32, from number `first` on."""
    sizes = np.array([len(s) for s in sets])
    begin = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), values), np.uint32)
    flat = np.concatenate(sets)
    step = 1 << 15  # stay in the cache
    cuts, at = [], 0
    while at < len(sets):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + step)))
        cuts.append((at, to))
        at = to
    for at, to in cuts:
        part = flat[begin[at] : begin[to - 1] + sizes[to - 1]]
        for k in range(values):
            out[at:to, k] = np.minimum.reduceat((part * _A[first + k] + _B[first + k]) >> np.uint64(32), begin[at:to] - begin[at])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = shingle_sets(batch.column("text"), WIDTH)
        full = [i for i, s in enumerate(sets) if len(s)]
        nodes, keys, marks = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if full:
            sig = signatures([sets[i] for i in full])
            begins = np.zeros((len(full), TREES), np.uint64)
            for t in range(TREES):
                x = np.full(len(full), t + 1, np.uint64)
                for d in range(DEPTH):
                    x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ sig[:, t * STRIDE + d].astype(np.uint64)
                    x ^= x >> np.uint64(29)
                    x *= np.uint64(0xC4CEB9FE1A85EC53)
                begins[:, t] = x ^ (x >> np.uint64(32))
            low = (sig & 0xFF).astype(np.uint8)
            for row, i in enumerate(full):
                nodes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                keys[i], marks[i] = begins[row].view(np.int64), low[row].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
            ["doc_id", "text_key", "n_shingles", "node", "keys", "marks"],
        )


def _orders(nodes: DataFrame, dense: DataFrame) -> DataFrame:
    """The rows of all trees, each tree in sorted order over range partitions that cut runs of dense keys only. nodes: node, label, keys, marks and maybe fine."""
    turned = F.concat(F.expr(f"substring(marks, tree * {STRIDE} + 1, {VALUES})"), F.expr(f"substring(marks, 1, tree * {STRIDE})"))
    more = [c for c in nodes.columns if c == "fine"]
    rows = nodes.select("node", "label", "marks", *more, F.posexplode("keys").alias("tree", "key")).select("key", turned.alias("marks"), "node", "label", *more)
    rows = rows.join(to_all(dense.withColumn("dense", F.lit(True))), "key", "left")
    placed = rows.repartitionByRange("key", *(F.when(F.col("dense"), F.col(c)) for c in ("marks", "node")))
    return placed.drop("dense").sortWithinPartitions("key", "marks", "node")


def _scan(task: str):
    """A scan of sorted rows for agreeing neighbours within WINDOW. task: "nearest" gives pairs, the nearest on each side;
    "open" gives the nodes that have one with another label; "pairs" gives all pairs with different labels whose fine signatures agree too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = {"marks": VALUES, "node": 16, "label": 16} | ({"fine": FINE} if task == "pairs" else {})
        old: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, w) for c, w in widths.items()}
            rows["key"] = batch.column("key").to_numpy(zero_copy_only=False)
            carried = len(old["key"]) if old else 0
            rows = {c: np.concatenate([old[c], x]) if old else x for c, x in rows.items()}
            key, marks, node, label = (rows[c] for c in ("key", "marks", "node", "label"))
            before, after = np.ones(len(key), bool), np.ones(len(key), bool)  # still without a neighbour on this side
            found: list[tuple[np.ndarray, np.ndarray]] = []
            new = np.arange(carried, len(key))
            for off in range(1, WINDOW + 1):
                new = new[new >= off]
                new = new[key[new] == key[new - off]]  # a run of equal keys is unbroken
                if not len(new):
                    break
                j = new[before[new] | after[new - off]] if task != "pairs" else new
                if task != "nearest":
                    j = j[(label[j] != label[j - off]).any(axis=1)]
                for part in np.array_split(j, max(1, len(j) // 20_000)):
                    hit = part[(marks[part] == marks[part - off]).sum(axis=1) >= AGREE]
                    if task == "pairs" and len(hit):
                        hit = hit[(rows["fine"][hit] == rows["fine"][hit - off]).sum(axis=1) >= FINE_AGREE]
                    if len(hit):
                        found.append((hit, hit - off))
                        before[hit] = False
                        after[hit - off] = False
            if found:
                right, left = ([x.tobytes() for x in np.ascontiguousarray(node[np.concatenate(x)]).view("V16").ravel()] for x in zip(*found, strict=True))
                if task == "open":
                    out = [(x,) for x in {*left, *right}]
                else:
                    out = list({(min(x, y), max(x, y)) for x, y in zip(left, right, strict=True) if x != y})
                names = ["node"] if task == "open" else ["a", "b"]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in range(len(names))], names)
            keep = max(len(key) - WINDOW, int(np.searchsorted(key, key[-1])))  # only the last run can go on
            old = {c: x[keep:] for c, x in rows.items()}

    return scan


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        low = (signatures(shingle_sets(batch.column("text"), WIDTH), VALUES, FINE) & 0xFF).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in low], pa.binary())], ["node", "fine"])


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of this task hold the shingles of a slot, where there are several."""
    total = np.zeros(SLOTS, np.int64)
    for batch in pieces(batches, "text"):
        sets = shingle_sets(batch.column("text"), WIDTH)
        if sets:
            total += np.bincount(_slots(np.concatenate(sets)), minlength=SLOTS)
    some = np.flatnonzero(total > 1)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "sets"])


def _firsts(weight: np.ndarray):
    """The first shingles of each set by weight that a set similar enough can share first. At place p (from 0) of a set of n the two share n - p at most,
    so `most` is the largest size of such another set; it is no less than 3/4 of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            at: list[int] = []
            for i, s in enumerate(shingle_sets(batch.column("text"), WIDTH)):
                n = len(s)
                first = s[np.lexsort((s, weight[_slots(s)]))[: n - -(-LINK * n // 100) + 1]]
                most = (100 + LINK) * (n - np.arange(len(first))) // LINK - n
                out.append((first.view(np.int64), np.full(len(first), n), most))
                at += [i] * len(first)
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(pa.array(at, pa.int64())) for c in ("node", "label"))], ["shingle", "n", "most", "node", "label"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle and cell (home, guest): pairs of a row at home and a guest with different labels, possible sizes and agreeing signatures."""

    def pairs(rows: dict[str, np.ndarray]) -> set[tuple[bytes, bytes]]:
        guest = rows["guest"]
        x, y = ({c: v[side] for c, v in rows.items()} for side in (np.flatnonzero(~guest), np.flatnonzero(guest)))
        found: set[tuple[bytes, bytes]] = set()
        labels = np.unique(rows["label"].view("V16").ravel(), return_inverse=True)[1].reshape(-1)
        lx, ly = labels[~guest], labels[guest]
        nx, ny = x["n"][:, None], y["n"][None]
        ok = (lx[:, None] != ly[None]) & (ny <= x["most"][:, None]) & (nx <= y["most"][None]) & (100 * np.minimum(nx, ny) >= LINK * np.maximum(nx, ny))
        left, right = np.nonzero(ok)
        for part in np.array_split(np.arange(len(left)), max(1, len(left) // 20_000)):
            i, j = left[part], right[part]
            hit = (x["marks"][i] == y["marks"][j]).sum(axis=1) >= AGREE
            ends = (x["node"][i[hit]].copy().view("V16").ravel(), y["node"][j[hit]].copy().view("V16").ravel())
            found |= {(min(p, q), max(p, q)) for p, q in zip(*(([v.tobytes() for v in e]) for e in ends), strict=True)}
        return found

    widths, plain = {"node": 16, "label": 16, "marks": VALUES}, ("shingle", "home", "room", "guest", "n", "most")
    old: dict[str, np.ndarray] = {}

    def sent(found: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, w) for c, w in widths.items()}
        rows |= {c: batch.column(c).to_numpy(zero_copy_only=False) for c in plain}
        rows = {c: np.concatenate([old[c], x]) if old else x for c, x in rows.items()}
        same = np.logical_and.reduce([rows[c][1:] == rows[c][:-1] for c in ("shingle", "home", "room")])
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist()]
        found = set()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                found |= pairs({c: x[a:b] for c, x in rows.items()})
        yield sent(found)
        old = {c: x[cuts[-1] :] for c, x in rows.items()}  # 2 * BLOCK rows of one cell, about
    if old:
        yield sent(pairs(old))


def _by_shingles(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with different labels that may be similar enough, found by shingles. labels: node, label, marks; texts: node, text.

    Of the nodes of a shingle, those with its most frequent label needn't meet each other: the others are guests of every block of nodes.
    """
    both = texts.join(labels.select("node", "label"), "node")
    counts = both.select("text").mapInArrow(_frequent, "slot long, sets long").groupBy("slot").agg(F.sum("sets").alias("sets")).toArrow()  # SLOTS rows at most
    weight = np.zeros(SLOTS, np.int32)
    weight[counts.column("slot").to_numpy()] = np.minimum(counts.column("sets").to_numpy(), 2**31 - 1)
    firsts = staged(both.mapInArrow(_firsts(weight), "shingle long, n long, most long, node binary, label binary"), "firsts")
    # the smaller of two sets has most >= n, so a row needs such a one no larger than its most
    smallest = firsts.where("most >= n").groupBy("shingle").agg(F.min("n").alias("least"))
    fit = firsts.join(smallest, "shingle").where("most >= least").drop("least")
    by_label = fit.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    live = by_label.groupBy("shingle").agg(F.sum("n").alias("nodes"), F.max("n").alias("top"), F.expr("max_by(label, struct(n, label))").alias("major"))
    live = live.where("nodes > top").select("shingle", "major", F.expr(f"int(ceil(nodes / {BLOCK}))").alias("homes"), F.expr(f"int(ceil((nodes - top) / {BLOCK}))").alias("rooms"))
    rows = fit.join(live, "shingle").join(labels.select("node", "marks"), "node")
    at = lambda blocks: F.expr(f"int(pmod(xxhash64(node), {blocks}))")
    rows = rows.withColumn("own_home", at("homes")).withColumn("own_room", at("rooms"))
    cells = F.expr("""concat(transform(sequence(0, rooms - 1), r -> struct(own_home as home, r as room, false as guest)),
        if(label = major, cast(array() as array<struct<home:int,room:int,guest:boolean>>), transform(sequence(0, homes - 1), h -> struct(h as home, own_room as room, true as guest))))""")
    rows = rows.withColumn("cell", F.explode(cells)).select("shingle", "cell.*", "n", "most", "node", "label", "marks")
    return rows.repartition("shingle", "home", "room").sortWithinPartitions("shingle", "home", "room").mapInArrow(_meet, "a binary, b binary").distinct()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough, joined within the task to stars."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for part in pieces(pieces([batch], "text_a"), "text_b"):
            left, right = shingle_sets(part.column("text_a"), WIDTH), shingle_sets(part.column("text_b"), WIDTH)
            for x, y, s, t in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), left, right, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= LINK * (len(s) + len(t) - both):
                    p, q = sorted((root(x), root(y)))
                    parent[q] = p
    out = [(x, root(x)) for x in parent]
    out = [(x, y) for x, y in out if x != y]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect what the confirmed pairs connect. texts: node, text, a row a node."""
    a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    b = a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return b.mapInArrow(_confirm, "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable; alternating large stars and small stars until nothing moves."""
    now = staged(edges.select("u", "v").distinct(), "edges")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable), kept, text_key (MD5 of the text).

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows with a null id never give
    a component its id and are not kept in it; a component whose ids are all null has a null one, and its rows are kept. Repeated rows share a component;
    rows with its smallest id are all kept. Other columns of docs play no part.
    """
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text_key"))
    feats = staged(keys.mapInArrow(_features, "doc_id long, text_key binary, n_shingles long, node binary, keys array<long>, marks binary"), "shingles")
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    ids = F.min("doc_id").alias("least_id")
    classes = staged(feats.where("node is not null").groupBy("node").agg(ids, one, F.first("keys").alias("keys"), F.first("marks").alias("marks")), "classes")
    begins = classes.select("node", F.explode("keys").alias("key"))
    dense = staged(begins.groupBy("key").count().where(f"count > {WINDOW}").select("key"), "dense")
    crowd = staged(begins.join(to_all(dense), "key").select("node").distinct(), "crowd")
    pairs = staged(_orders(classes.withColumn("label", F.col("node")), dense).mapInArrow(_scan("nearest"), "a binary, b binary").distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).union(crowd).distinct()
    asked = staged(asked.join(classes, "node").select("node", "one.*", "keys", "marks"), "asked")
    # one text for each node that has a candidate or stands in a dense run
    wanted = asked.select("node", F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key"))
    texts = keys.join(wanted, (F.col("text_key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id")))
    texts = staged(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    first = components(confirmed(pairs, texts))
    labels = staged(asked.join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "keys", "marks"), "labels")
    still = staged(_orders(labels, dense).mapInArrow(_scan("open"), "node binary").distinct(), "open")
    if not still.isEmpty():
        fine = labels.join(texts.join(still, "node").mapInArrow(_fine, "node binary, fine binary"), "node")
        more = staged(_orders(fine, dense).mapInArrow(_scan("pairs"), "a binary, b binary").distinct(), "pairs")
        if not more.isEmpty():
            first = components(first.select(F.col("node").alias("u"), F.col("label").alias("v")).unionAll(confirmed(more, texts)))
    if not crowd.isEmpty():
        now = staged(crowd.join(labels.select("node", "marks"), "node").join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "marks"), "crowd")
        far = staged(_by_shingles(now, texts), "pairs")
        if not far.isEmpty():
            first = components(first.select(F.col("node").alias("u"), F.col("label").alias("v")).unionAll(confirmed(far, texts)))
    groups = classes.select("node", "least_id").join(first, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    least = groups.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = groups.join(least, "label").select("node", "component_id")
    out = feats.select("doc_id", "n_shingles", "node", "text_key").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"), "text_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, with one row of each group of near-duplicates and all rows that have no words.

    The row that stays has the smallest id (if all ids of a group are null, the smallest text digest); of repeated rows one stays. Rows with a null or
    empty text, or one without words, all stay. No name of docs' columns clashes.
    """
    mark = uuid.uuid4().hex
    key, group, one, many, its_id, its_key = (f"{c}_{mark}" for c in ("key", "group", "one", "rows", "id", "its_key"))  # clash with no column of docs
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col("text").cast("binary"))))
    found = near_duplicates(docs)
    own = F.coalesce(F.col("component_id").cast("string").cast("binary"), F.col("text_key"))
    best = found.where("n_shingles > 0 and kept").groupBy(own.alias(group)).agg(F.min(F.struct("doc_id", "text_key")).alias(one), F.count("*").alias(many))
    best = staged(best.select(F.col(f"{one}.doc_id").alias(its_id), F.col(f"{one}.text_key").alias(its_key), many), "kept")
    stay = keyed.join(best, (F.col(key) == F.col(its_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)))
    if not best.where(F.col(many) > 1).isEmpty():
        stay = stay.where(F.col(many) == 1).unionAll(stay.where(F.col(many) > 1).dropDuplicates([its_id, key]))
    bare = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return stay.select(*docs.columns).unionAll(docs.where(bare))
