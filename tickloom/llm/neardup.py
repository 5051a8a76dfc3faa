"""Near-duplicate documents: chosen-path set similarity join over minwise sketches, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import staged, table
from tickloom.llm.components import components
from tickloom.llm.registry import query
from tickloom.llm.shingles import COORDS, mix, shingle_set, similar, sketch

C = F.col
#: Independent trees, the depth all paths have, how deep large nodes go on, and the size from which a node is large.
TREES, DEPTH, MAX_DEPTH, NODE = 8, 4, 10, 256
#: Trees for the documents of large nodes: a tree keeps fewer pairs the deeper it goes, 36 in 100 at ``MAX_DEPTH``.
DEEP_TREES = 18
#: How far below the threshold an estimated similarity may lie for the pair to be confirmed (4.8 standard errors at 0.8).
SLACK = 0.12
#: Documents of a large node that meet all others of it.
PIVOTS = 3
#: Rows a document, on average, that a large node may take for its documents outside the largest component to be settled; to branch deeper takes more.
SETTLED = 4


def _sign(x: np.ndarray) -> tuple[int, int, int]:
    """Size and 128 bits that tell sets apart."""
    return len(x), int(np.bitwise_xor.reduce(mix(x))) if len(x) else 0, int(mix(x * np.uint64(3)).sum())


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _features(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            n, s1, s2, sk, marks, known = [], [], [], [], [], {}
            for text in frame["text"]:
                x = shingle_set(text, width)
                sign = _sign(x)
                if sign not in known:
                    low = sketch(x)
                    # Two bytes of each minwise token are enough to branch on, and one to compare sketches.
                    known[sign] = low.astype(np.uint16).tobytes(), low.astype(np.uint8).tobytes()
                n.append(sign[0])
                s1.append(sign[1])
                s2.append(sign[2])
                sk.append(known[sign][0])
                marks.append(known[sign][1])
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n": n, "s1": _signed(s1), "s2": _signed(s2), "sketch": sk, "marks": marks})

    return run


def _branch(row: np.ndarray, path: np.ndarray, sketches: np.ndarray, levels: int, more: float) -> tuple[np.ndarray, np.ndarray]:
    """Walk ``levels`` down: every node selects one coordinate, or two with probability ``more``, and a document goes on to
    the child of its minwise token there. Two documents as similar as 1 / (1 + more) expect to share as many nodes a level deeper."""
    for _ in range(levels):
        h = mix(path)
        first = (h % np.uint64(COORDS)).astype(np.int64)
        second = ((h >> np.uint64(8)) % np.uint64(COORDS - 1)).astype(np.int64) + 1 + first
        also = (h >> np.uint64(32)) < np.uint64(int(more * 2**32))
        coord = np.r_[first, second[also] % COORDS]
        row, path = np.r_[row, row[also]], np.r_[path, path[also]]
        path = mix(path ^ mix(sketches[row, coord].astype(np.uint64) + (coord.astype(np.uint64) << np.uint64(40))))
    return row, path


def _paths(levels: int, more: float, trees: tuple[int, int] | None = None):
    """Walk down from the roots of the trees of a range, or from the paths at hand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if frame.empty:
                continue
            sketches = np.frombuffer(b"".join(frame["sketch"]), np.uint16).reshape(-1, COORDS)
            if trees:
                roots = mix(np.arange(trees[0] + 1, trees[1] + 1, dtype=np.uint64))
                row, path = np.repeat(np.arange(len(frame)), len(roots)), np.tile(roots, len(frame))
            else:
                row, path = np.arange(len(frame)), frame["path"].to_numpy().view(np.uint64)
            row, path = _branch(row, path, sketches, levels, more)
            yield pd.DataFrame({"path": path.view(np.int64), "rep": frame["rep"].to_numpy()[row]})

    return run


def _walked(rows: DataFrame, levels: int, more: float, trees: tuple[int, int] | None = None) -> DataFrame:
    """``path, rep, size``: the nodes of two documents or more that lie ``levels`` below the rows."""
    rows = staged(rows.mapInPandas(_paths(levels, more, trees), "path long, rep long").distinct(), "paths")
    sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where(C("size") > 1)
    return staged(rows.join(sizes, "path"), "nodes")


def _deeper(sized: DataFrame, sketches: DataFrame, more: float) -> DataFrame:
    """``path, rep, size``: large nodes go on to branch until ``MAX_DEPTH``, or until they are not large.

    What a tree loses on the way down, further trees make up for: documents of these nodes walk ``DEEP_TREES`` of them.
    """
    crowd = sketches.join(sized.select("rep").distinct(), "rep", "left_semi")
    sized, done, depth = sized.unionByName(_walked(crowd, DEPTH, more, (TREES, DEEP_TREES))), None, DEPTH
    while True:
        last = depth >= MAX_DEPTH or sized.where(C("size") > NODE).isEmpty()
        small = sized if last else sized.where(C("size") <= NODE)
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        sized = _walked(sized.where(C("size") > NODE).select("path", "rep").join(sketches, "rep"), 2, more)
        depth += 2


def _forest(rows: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """``a, b, linked``: a spanning forest of most similar pairs of each block of the nodes, confirmed on full sets; ``PIVOTS``
    documents of a large node come to all its blocks."""
    pivots = rows.where(C("size") > NODE).groupBy("path").agg(F.expr(f"slice(array_sort(collect_set(xxhash64(rep, path) % 4096)), 1, {PIVOTS})").alias("chosen"))
    led = rows.join(pivots, "path", "left")
    guest = F.coalesce(F.array_contains("chosen", F.xxhash64("rep", "path") % 4096), F.lit(False))
    tried = staged(_pairs(_blocks(led.withColumn("main", C("rep")), guest), least, True), "forest")
    return staged(_confirm(tried, sets, percent), "confirmed")


def _linked(links: DataFrame) -> DataFrame:
    return links.where("linked").select(C("a").alias("u"), C("b").alias("v"))


def _open(large: DataFrame, roots: DataFrame) -> DataFrame:
    """``path`` of the large nodes that are not settled. A node is settled if so few documents lie outside its largest component
    that all of them can meet all of its blocks for at most ``SETTLED`` rows a document."""
    comp = large.join(roots, C("rep") == C("node"), "left").select("path", "size", F.coalesce("root", "rep").alias("comp"))
    shares = comp.groupBy("path", "comp").agg(F.count("*").alias("share"), F.max("size").alias("size"))
    most = shares.groupBy("path").agg(F.max("share").alias("share"), F.max("size").alias("size"))
    return most.where((C("size") - C("share")) * F.ceil(C("size") / NODE) > SETTLED * C("size")).select("path")


def _root(of: dict, x):
    while of.get(x, x) != x:
        of[x] = of.get(of[x], of[x])
        x = of[x]
    return x


def _candidates(least: float, spanning: bool):
    """Pairs of one block whose sketches agree on ``least`` and whose components differ: a spanning forest of the most similar ones, or
    all, told as one document and the other one's component.

    Partitions come sorted by block and are cut where it changes; a block never exceeds a few times ``NODE`` rows.
    """

    def compare(comp, home, n, marks) -> np.ndarray:
        found = []
        for i in range(len(comp) - 1):
            later = slice(i + 1, None)
            small, large = np.minimum(n[later], n[i]), np.maximum(n[later], n[i])
            other = np.flatnonzero((comp[later] != comp[i]) & (home[later] | home[i]) & (small >= (least + SLACK) * large - 1e-9)) + i + 1
            if len(other):
                agree = (marks[other] == marks[i]).mean(1)
                near = agree >= least
                found += zip((-agree[near]).tolist(), [i] * int(near.sum()), other[near].tolist())
        if spanning:
            of, kept = {}, []
            for _, i, j in sorted(found):
                x, y = _root(of, comp[i]), _root(of, comp[j])
                if x != y:
                    of[max(x, y)] = min(x, y)
                    kept.append((0, i, j))
            found = kept
        return np.array([(i, j) for _, i, j in found], np.int64).reshape(-1, 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in _whole(batches, ["path", "block"]):
            rep, comp, main, home, n = (rows[c].to_numpy() for c in ("rep", "comp", "main", "home", "n"))
            marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(-1, COORDS)
            # Most blocks are pairs: all at once.
            i = starts[ends - starts == 2]
            j = i + 1
            ok = (comp[i] != comp[j]) & (home[i] | home[j]) & (np.minimum(n[i], n[j]) >= (least + SLACK) * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[ok], j[ok]
            ok = (marks[i] == marks[j]).mean(1) >= least if len(i) else np.zeros(0, bool)
            pairs = [np.stack([i[ok], j[ok]], 1)]
            for x, y in zip(starts, ends):
                if y - x > 2 and (comp[x:y] != comp[x]).any():
                    pairs.append(x + compare(comp[x:y], home[x:y], n[x:y], marks[x:y]))
            i, j = np.concatenate(pairs).T
            if spanning:
                yield pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})
            else:  # a document outside the node's main component, and the component it may belong to
                swap = comp[i] == main[i]
                yield pd.DataFrame({"a": np.where(swap, rep[j], rep[i]), "b": np.where(swap, comp[i], comp[j])}).drop_duplicates()

    return run


def _whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Frames of whole groups of a partition that is sorted by ``keys``, with the groups' bounds; the last group waits for the next batch."""

    def bounds(rows: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(1)
        return np.flatnonzero(new)

    held = None
    for frame in batches:
        rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
        starts = bounds(rows)
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], starts[:-1], starts[1:]
        held = rows.iloc[starts[-1]:].reset_index(drop=True) if len(starts) else None
    if held is not None:
        yield held, np.zeros(1, np.int64), np.array([len(held)])


def _pairs(blocks: DataFrame, least: float, spanning: bool) -> DataFrame:
    rows = blocks.repartition("path", "block").sortWithinPartitions("path", "block", "rep")
    return rows.mapInPandas(_candidates(least, spanning), "a long, b long").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` for pairs of ids, by their full sets; each set is shuffled to its pairs, which carry it to the other side."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yes = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(frame["x"], frame["y"])]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "linked": np.array(yes, bool)})

    left = pairs.join(sets.select(C("rep").alias("a"), C("shingles").alias("x")), "a")
    both = left.join(sets.select(C("rep").alias("b"), C("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(check, "a long, b long, linked boolean")


def _join_components(reach: DataFrame, roots: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """Links (``a, b``) of documents ``a`` into components ``b`` they may belong to: one for each block of members that has any.

    Every document meets all members of the component once, however many nodes they share: members and documents are cut
    into blocks of about ``NODE`` and every pair of blocks is one group, where full sets decide.
    """
    sets = sets.join(reps.select("rep", "n", "marks").dropDuplicates(["rep"]), "rep")
    of = sets.select("rep").join(roots, C("rep") == C("node"), "left").select("rep", F.coalesce("root", "rep").alias("c"))
    sizes = of.groupBy("c").agg(F.count("*").alias("members")).join(reach.groupBy(C("b").alias("c")).agg(F.count("*").alias("guests")), "c")
    m, g = (F.ceil(C(x) / NODE).cast("int") for x in ("members", "guests"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    spot = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    inside = of.join(sizes, "c").select("c", "rep", spot(m).alias("i"), every(g).alias("j"), F.lit(False).alias("guest"))
    outside = reach.select(C("a").alias("rep"), C("b").alias("c")).join(sizes, "c").select("c", "rep", every(m).alias("i"), spot(g).alias("j"), F.lit(True).alias("guest"))
    rows = inside.unionByName(outside).join(sets, "rep").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "rep")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, ends in _whole(batches, ["c", "i", "j"]):
            guest, rep, n = (frame[c].to_numpy() for c in ("guest", "rep", "n"))
            full = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
            marks = np.frombuffer(b"".join(frame["marks"]), np.uint8).reshape(-1, COORDS)
            found = []
            for x, y in zip(starts, ends):
                members = np.flatnonzero(~guest[x:y]) + x
                for a in np.flatnonzero(guest[x:y]) + x:
                    fit = members[100 * np.minimum(n[members], n[a]) >= percent * np.maximum(n[members], n[a])]
                    agree = (marks[fit] == marks[a]).mean(1) if len(fit) else np.zeros(0)
                    for k in np.argsort(-agree, kind="stable"):
                        if agree[k] < least:
                            break
                        if similar(full[a], full[fit[k]], percent):
                            found.append((rep[a], rep[fit[k]]))
                            break
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return rows.mapInPandas(check, "a long, b long")


def _blocks(rows: DataFrame, guest) -> DataFrame:
    """Cut nodes into blocks of about ``NODE`` by a hash; rows for which ``guest`` holds come to every block of their node."""
    n = F.ceil(C("size") / NODE).cast("int")
    own = F.pmod(F.xxhash64("rep", "path"), n).cast("int")
    every = F.when(guest & (n > 1), F.sequence(F.lit(0), n - 1)).otherwise(F.array(own))
    return rows.withColumn("own", own).withColumn("block", F.explode(every)).withColumn("home", C("own") == C("block")).drop("own")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    A document's set holds its distinct shingles of ``width`` words. Documents whose sets share ``percent`` per cent of their union are
    linked; ``component_id`` is the smallest doc_id reachable and ``kept`` marks it. Null and blank texts link with nothing, nor
    do rows without a doc_id, whose component is null and which are not kept. Rows that share a doc_id are one node.

    Equal sets are folded to one representative. ``TREES`` independent trees branch representatives by selected minwise tokens;
    a pair at the threshold shares a node of one tree in 58 of 100 cases, thus one of eight trees in 998 of 1000, and
    more similar pairs more often. Where large nodes branch deeper, down to 36 of 100, ``DEEP_TREES`` keep it at 998. A node is compared exhaustively on sketches in blocks of ``NODE``. First a spanning forest of
    each block's most similar pairs is confirmed on the full sets, so a group of near copies costs one confirmation a
    document instead of one a pair; then every document in reach of the threshold of another component meets all of its members. In nodes that stay
    large to ``MAX_DEPTH``, near copies throughout, ``PIVOTS`` documents meet all blocks at first, and then all documents outside the
    node's largest component do.
    """
    features = staged(docs.select(C("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _features(width), "doc_id long, n long, s1 long, s2 long, sketch binary, marks binary"), "features")
    sign = ["n", "s1", "s2"]
    reps = features.where((C("n") > 0) & C("doc_id").isNotNull()).groupBy(*sign).agg(F.min("doc_id").alias("doc"), F.max("sketch").alias("sketch"), F.max("marks").alias("marks"))
    reps = staged(_named(reps, sign), "representatives")
    # Rows of one doc_id are one node, whatever their sets.
    known = features.where((C("n") > 0) & C("doc_id").isNotNull()).select("doc_id", *sign).distinct()
    shared = known.groupBy("doc_id").agg(F.count("*").alias("sets")).where(C("sets") > 1).select("doc_id")
    held = known.join(shared, "doc_id").join(reps.select(*sign, "rep"), sign)
    same = held.groupBy("doc_id").agg(F.min("rep").alias("v")).join(held, "doc_id").where(C("rep") != C("v")).select(C("rep").alias("u"), "v")
    same = staged(same.distinct(), "same-id")
    least = percent / 100 - SLACK
    marks = reps.select("rep", "n", "marks").dropDuplicates(["rep"])
    sketches, more = reps.select("rep", "sketch"), 100 / percent - 1
    nodes = _walked(sketches, DEPTH, more, (0, TREES))

    wanted = nodes.select("rep").distinct().join(reps.select("rep", "doc"), "rep").select("doc").distinct()
    full = docs.select(C("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc", "left_semi")
    sets = full.mapInPandas(_sets(width), "doc long, n long, s1 long, s2 long, shingles binary")
    sets = staged(sets.join(reps.select(*sign, "doc", "rep"), [*sign, "doc"]).dropDuplicates(["rep"]).select("rep", "shingles"), "sets")

    large, first, comp = nodes.where(C("size") > NODE), None, C("rep")
    rows = nodes
    if not large.isEmpty():
        first = _forest(staged(large.join(marks, "rep").withColumn("comp", C("rep")), "large"), sets, percent, least)
        roots = staged(components(_linked(first)), "large-roots")
        unsettled = staged(_open(large, roots), "large-open")
        if not unsettled.isEmpty():
            deeper = _deeper(nodes.join(unsettled, "path", "left_semi"), sketches, more)
            nodes = nodes.join(unsettled, "path", "left_anti").unionByName(deeper)
        rows, comp = nodes.join(roots, C("rep") == C("node"), "left"), F.coalesce("root", "rep")
    rows = staged(rows.withColumn("comp", comp).select("path", "rep", "size", "comp").join(marks, "rep"), "members")
    links = _forest(rows, sets, percent, least)
    if first is not None:
        links = links.unionByName(first)
    roots = staged(components(_linked(links).unionByName(same)), "roots")
    rows = rows.drop("comp").join(roots, C("rep") == C("node"), "left").select("path", "rep", "size", "n", "marks", F.coalesce("root", "rep").alias("comp"))
    shares = rows.groupBy("path", "comp").agg(F.count("*").alias("share")).groupBy("path").agg(F.count("*").alias("parts"), F.max_by("comp", "share").alias("main"))
    rows = rows.join(shares.where(C("parts") > 1), "path")
    reach = staged(_pairs(_blocks(rows, C("comp") != C("main")), least, False), "rest")
    rest = staged(_join_components(reach, roots, reps, sets, percent, least), "confirmed-rest")
    roots = components(links.where("linked").select("a", "b").unionByName(rest).select(C("a").alias("u"), C("b").alias("v")).unionByName(same))

    rooted = reps.join(roots, C("rep") == C("node"), "left").select(*sign, "doc", F.coalesce("root", "rep").alias("root"))
    least_doc = rooted.groupBy("root").agg(F.min("doc").alias("component"))
    classes = rooted.join(least_doc, "root").select(*[C(c).alias(f"{c}_") for c in sign], "component")
    out = features.drop("sketch", "marks").join(classes, (C("n") == C("n_")) & (C("s1") == C("s1_")) & (C("s2") == C("s2_")), "left")
    component = F.when(C("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", C("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == C("doc_id"), F.lit(False)).alias("kept"))


def _named(reps: DataFrame, sign: list[str]) -> DataFrame:
    """Adds ``rep``: the class's smallest doc_id; where several classes have the same one, all but one take a hash of their set, below zero."""
    first = reps.groupBy("doc").agg(F.min(F.struct(*sign)).alias("__first"), F.count("*").alias("__n")).where(C("__n") > 1).drop("__n")
    other = C("__first").isNotNull() & (F.struct(*sign) != C("__first"))
    hashed = F.xxhash64(*sign).bitwiseOR(F.lit(-(2**63)))
    return reps.join(first, "doc", "left").withColumn("rep", F.when(other, hashed).otherwise(C("doc"))).drop("__first")


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            x = [shingle_set(t, width) for t in frame["text"]]
            signs = [_sign(s) for s in x]
            yield pd.DataFrame({"doc": frame["doc"], "n": [s[0] for s in signs], "s1": _signed([s[1] for s in signs]), "s2": _signed([s[2] for s in signs]), "shingles": [s.tobytes() for s in x]})

    return run


@query("op8_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
