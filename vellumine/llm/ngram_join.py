"""N-gram Jaccard join by rare-first prefix filtering, as components.

Sets are the distinct 5-word shingles of texts; two sets link at a Jaccard similarity of at
least 80/100. Equal sets are one node, however many documents have it.

1. Document frequencies. Documents stand in hashed chunks. A chunk sends each of its distinct
   shingles (40 bits of the hash, and how many of its documents have it) once, packed by hash
   range; a range's task adds up and answers each chunk with the shingles that more than one
   document has and how frequent they are. A very frequent shingle is one entry a chunk.
2. A document shares at most its shared shingles, so a document with fewer of them than 80% of
   its set links with none. The others, usually few, keep their shared shingles.
3. Prefix filter: in the global order (rarest first, then by hash) two linked sets share one of
   their first n - ceil(0.8 n) + 1 shingles. Unshared shingles come first and match nothing, so
   only what is left of the prefix is joined on, with length and positional filters.
4. Pairs. Groups of at most ``SMALL`` sets with one prefix shingle give their pairs, each made
   distinct and verified once (suffix filter, then exact overlap). In larger groups all pairs
   would be quadratic, so the group's smallest set (pivot) is first paired with its others. Then
   components are taken: pairs within one need no look any more. What is open, sets of other
   components against all of the group, is counted in blocks of ``BLOCK`` by ``BLOCK`` sets, which
   send rows per block and return one link per pair of components. No link between components
   is lost, and none inside one is needed.

A set's hashes have 64 bits and its name 128; verification compares the 64-bit hashes. The joint
frequency of step 1 may be too high if 40 bits collide, which changes the order, not the result.

Null, empty and wordless texts have no shingle and their own component. Rows with a null id take
part; a component's id is its smallest id that is not null. Repeated rows have a row each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import discard, materialise, one_model, partitions
from vellumine.llm.components import components
from vellumine.llm.shingles import shingle_sets, signature

#: Similarity as a fraction of whole numbers.
NUM, DEN = 80, 100
CHUNK_DOCS = 4000
#: Groups up to this size give their pairs outright.
SMALL = 24
#: Sets in a block of a large group.
BLOCK = 512
_SHIFT = np.uint64(24)


def least_overlap(n, m):
    """Smallest overlap at which sets of n and m elements link: I/(n+m-I) >= NUM/DEN."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _pack(keys: np.ndarray, marks: np.ndarray) -> bytes:
    """Ascending 40-bit keys and a byte each: differences by byte plane, then deflated."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T
    return zlib.compress(np.ascontiguousarray(planes).tobytes() + marks.tobytes(), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    n = len(flat) // 6
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = flat[: 5 * n].reshape(5, n).T
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64), flat[5 * n :]


def _chunk_sets(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    sets = shingle_sets(texts)
    return sets, [signature(s) for s in sets]


def document_sets(df: DataFrame, chunks: int) -> DataFrame:
    """Steps 1 and 2: (doc_id, n, sig, shared) per row; ``shared`` holds the shared shingles of a
    set that may link, rarest first, 8 bytes each, at one row a chunk of those that have the set.
    Texts are shuffled once: both passes over them read the same exchange."""
    ranges = max(1, chunks)
    docs = df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))

    def tally(table: pa.Table) -> pa.Table:
        one_model("shingles", lambda: None)
        sets, names = _chunk_sets(table.column("text").to_pylist())
        distinct = [s for s, _ in {name: (s, 0) for s, name in zip(sets, names)}.values()]
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *distinct]) >> _SHIFT, return_counts=True)
        marks = np.minimum(counts, 255).astype(np.uint8)
        part = ((keys * np.uint64(ranges)) >> np.uint64(40)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        held = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
        chunk = table.column("chunk")[0].as_py()
        payload = [_pack(keys[cuts[r] : cuts[r + 1]], marks[cuts[r] : cuts[r + 1]]) for r in held]
        return pa.table({"part": pa.array(held, pa.int32()), "chunk": pa.array([chunk] * len(held), pa.int32()), "payload": pa.array(payload, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        chunk_ids, raws = table.column("chunk").to_pylist(), table.column("payload").to_pylist()
        parts = [_unpack(r) for r in raws]
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([m for _, m in parts]).astype(np.int64)
        every, place = np.unique(keys, return_inverse=True)
        frequency = np.bincount(place, counts, len(every))
        rarity = np.minimum(np.log2(np.maximum(frequency, 1)) * 16, 255).astype(np.uint8)
        at, out = 0, []
        for k, _ in parts:
            own = place[at : at + len(k)]
            shared = frequency[own] >= 2
            out.append(_pack(k[shared], rarity[own][shared]))
            at += len(k)
        return pa.table({"chunk": pa.array(chunk_ids, pa.int32()), "payload": pa.array(out, pa.binary())})

    def select(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist() if table.num_rows else []
        sets, names = _chunk_sets(texts)
        parts = [_unpack(r) for r in answers.column("payload").to_pylist()]
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in parts]])
        rarity = np.concatenate([np.zeros(0, np.uint8), *[m for _, m in parts]])
        order = np.argsort(keys, kind="stable")
        keys, rarity = keys[order], rarity[order]
        packed: dict[bytes, bytes | None] = {}
        for s, name in zip(sets, names):
            if name in packed:
                continue
            packed[name] = None
            if len(s) and len(keys):
                h = s >> _SHIFT
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                if DEN * hit.sum() >= NUM * len(s):
                    mine, rare = s[hit], rarity[at[hit]]
                    packed[name] = mine[np.lexsort((mine, rare))].astype("<u8").tobytes()
        return pa.table({
            "doc_id": table.column("doc_id").cast(pa.int64()) if table.num_rows else pa.array([], pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array(names, pa.binary()),
            "shared": pa.array([packed.pop(name, None) for name in names], pa.binary()),
        })

    tallies = docs.groupBy("chunk").applyInArrow(tally, "part int, chunk int, payload binary")
    answers = tallies.groupBy("part").applyInArrow(answer, "chunk int, payload binary")
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(select, "doc_id long, n long, sig binary, shared binary")


def suffix_may(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """Suffix filter on sorted sets: split both at an element of y; the sizes of the sides bound
    the overlap."""
    if min(len(x), len(y)) < need:
        return False
    if depth == 0 or need <= 0 or not len(y):
        return True
    mid = len(y) // 2
    cut = int(np.searchsorted(x, y[mid]))
    left, right = min(cut, mid), min(len(x) - cut, len(y) - mid)
    return left + right >= need and suffix_may(x[:cut], y[:mid], need - right, depth - 1) and suffix_may(x[cut:], y[mid:], need - left, depth - 1)


def _verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; each node's set travels to its pairs."""

    def run(batches):
        for t in batches:
            keep_a, keep_b = [], []
            for a, b, n, m, x, y in zip(*(t.column(c).to_pylist() for c in range(6))):
                x, y = np.sort(np.frombuffer(x, "<u8")), np.sort(np.frombuffer(y, "<u8"))
                need = least_overlap(n, m)
                if suffix_may(x, y, need) and len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    keep_a.append(a)
                    keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.binary()), pa.array(keep_b, pa.binary())], names=["a", "b"])

    one = nodes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    two = nodes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(h, node(n, sig), pos): what is left of each node's prefix."""

    def run(batches):
        for t in batches:
            hs, ns, sigs, poss = [], [], [], []
            for sig, n, raw in zip(*(t.column(c).to_pylist() for c in range(3))):
                shared = np.frombuffer(raw, "<i8")
                first = n - len(shared)
                count = prefix(n) - first
                hs.append(shared[:count])
                ns.append(np.full(len(hs[-1]), n))
                poss.append(first + np.arange(len(hs[-1])))
                sigs += [sig] * len(hs[-1])
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ns)), pa.array(sigs, pa.binary()), pa.array(np.concatenate(poss))], names=["h", "n", "sig", "pos"])

    rows = nodes.select("sig", "n", "shared").mapInArrow(run, "h long, n long, sig binary, pos long")
    return rows.select("h", F.struct("n", "sig", "pos").alias("x"))


def _may_link(p, x):
    """Length and positional filters for two members of a prefix shingle's group."""
    need = F.ceil((p["n"] + x["n"]) * NUM / F.lit(float(NUM + DEN)) - 1e-6)
    long_enough = (p["n"] * DEN >= x["n"] * NUM) & (x["n"] * DEN >= p["n"] * NUM)
    bound = F.least(p["pos"], x["pos"]) + 1 + F.least(p["n"] - p["pos"], x["n"] - x["pos"]) - 1
    return long_enough & (bound >= need)


def _open_groups(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows (h, x) with their component and their group's size, without the groups that one
    component has alone."""
    if comps is None:
        tagged = rows.select("h", "x", F.col("x.sig").alias("comp"))
    else:
        tagged = rows.join(comps, F.col("x.sig") == F.col("node"), "left").select("h", "x", F.coalesce("root", "x.sig").alias("comp"))
    tagged = materialise(tagged, "prefix")
    sizes = tagged.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    found = materialise(tagged.join(sizes.select(F.col("h").alias("k"), "m"), F.col("h") == F.col("k")).drop("k"), "groups")
    discard(tagged)
    return found


def _links(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links among met pairs (p, x), each pair once."""
    met = met.filter(_may_link(F.col("p"), F.col("x")))
    pairs = met.select(F.least("p.sig", "x.sig").alias("a"), F.greatest("p.sig", "x.sig").alias("b")).distinct()
    return materialise(_verify(pairs, nodes), "verified")


def _grid_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between components in large groups. A group's largest component needs no look at
    itself: blocks of the others' sets meet blocks of all sets, a task each, which counts the
    overlaps of a block pair by matrix products and returns one link per pair of components that
    it joins. Rows travel once per block they meet, not once per pair."""
    by_comp = rows.groupBy("h", "comp").count()
    per = by_comp.groupBy("h").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    per = per.select(F.col("h").alias("k"), "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("nb"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("nu"))
    placed = rows.select("h", F.col("x.sig").alias("sig"), F.col("x.n").alias("n"), "comp").join(per, F.col("h") == F.col("k"))
    own = lambda n, seed: F.pmod(F.xxhash64("sig", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter(F.col("comp") != F.col("main")).select("h", "sig", "n", "comp", own("nu", 1).alias("i"), every("nb").alias("j"), F.lit(True).alias("is_left"))
    right = placed.select("h", "sig", "n", "comp", own("nb", 2).alias("j"), every("nu").alias("i"), F.lit(False).alias("is_left"))
    cells = left.unionByName(right).join(nodes.select(F.col("sig").alias("s"), "shared"), F.col("sig") == F.col("s"))

    def run(t: pa.Table) -> pa.Table:
        side = np.array(t.column("is_left").to_pylist())
        sigs, n = t.column("sig").to_pylist(), t.column("n").to_numpy()
        comp_names: dict[bytes, int] = {}
        comp = np.array([comp_names.setdefault(c, len(comp_names)) for c in t.column("comp").to_pylist()])
        raws = t.column("shared").to_pylist()
        rows_of = [np.flatnonzero(side), np.flatnonzero(~side)]
        links: list[tuple[bytes, bytes]] = []
        if len(rows_of[0]) and len(rows_of[1]):
            flat = [np.concatenate([np.frombuffer(raws[r], "<u8") for r in rs]) for rs in rows_of]
            who = [np.repeat(np.arange(len(rs)), [len(raws[r]) // 8 for r in rs]) for rs in rows_of]
            common = np.intersect1d(*flat)
            overlap = np.zeros((len(rows_of[0]), len(rows_of[1])), np.float32)
            for lo in range(0, len(common), 4096):
                part = common[lo : lo + 4096]
                sides = []
                for f, w, rs in zip(flat, who, rows_of):
                    at = np.minimum(np.searchsorted(part, f), len(part) - 1)
                    hit = part[at] == f
                    x = np.zeros((len(rs), len(part)), np.float32)
                    x[w[hit], at[hit]] = 1
                    sides.append(x)
                overlap += sides[0] @ sides[1].T
            a, b = rows_of
            linked = (overlap * (NUM + DEN) >= NUM * (n[a][:, None] + n[b][None, :])) & (comp[a][:, None] != comp[b][None, :])
            parent = list(range(len(comp_names)))

            def find(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            i, j = np.nonzero(linked)
            _, once = np.unique(comp[a][i].astype(np.int64) * len(comp_names) + comp[b][j], return_index=True)
            for k in once:
                u, v = find(int(comp[a[i[k]]])), find(int(comp[b[j[k]]]))
                if u != v:
                    parent[u] = v
                    links.append((sigs[a[i[k]]], sigs[b[j[k]]]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return materialise(cells.select("h", "i", "j", "is_left", "sig", "n", "comp", "shared").groupBy("h", "i", "j").applyInArrow(run, "a binary, b binary"), "grid")


def link_components(nodes: DataFrame) -> DataFrame:
    """Steps 3 and 4 on distinct sets (sig, n, shared): (node, root) of all linked nodes."""
    rows = _open_groups(_prefixes(nodes), None)
    small, large = rows.filter(F.col("m") <= SMALL), rows.filter(F.col("m") > SMALL).select("h", "x")
    met = small.select(F.col("h").alias("ph"), F.col("x").alias("p")).join(small, (F.col("ph") == F.col("h")) & (F.col("x") > F.col("p")) & _may_link(F.col("p"), F.col("x")))
    pivots = large.groupBy("h").agg(F.min("x").alias("p")).select(F.col("h").alias("ph"), "p")
    first = large.join(pivots, (F.col("h") == F.col("ph")) & (F.col("x") > F.col("p")))
    links = _links(met.select("p", "x").unionByName(first.select("p", "x")), nodes)
    comps = materialise(components(links), "components")
    rest = _open_groups(large, comps).select("h", "x", "comp")
    discard(rows, links)
    if not rest.isEmpty():
        links = comps.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_grid_links(rest, nodes))
        comps = materialise(components(links), "components")
    return comps


def jaccard_components(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): doc_id, n_shingles, component_id."""
    spark = df.sparkSession
    chunks = max(partitions(spark), -(-df.count() // CHUNK_DOCS))
    sets = materialise(document_sets(df, chunks), "sets")
    nodes = materialise(sets.filter(F.col("shared").isNotNull()).groupBy("sig", "n").agg(F.max("shared").alias("shared")), "nodes")
    docs = materialise(sets.select("doc_id", "n", "sig"), "documents")
    discard(sets)
    comps = link_components(nodes)
    discard(nodes)
    named = docs.filter("n > 0").select("doc_id", "n", "sig").join(comps, F.col("sig") == F.col("node"), "left")
    named = named.select("doc_id", "n", F.coalesce("root", "sig").alias("g"))
    ids = named.groupBy("g").agg(F.min("doc_id").alias("component_id")).select(F.col("g").alias("k"), "component_id")
    linked = named.join(ids, F.col("g") == F.col("k")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = docs.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
