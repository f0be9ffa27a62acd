"""N-gram Jaccard join by PartEnum signatures; exact.

Texts are sets of 5-word shingles (64-bit hashes). Equal sets form a class, and
classes are joined. Two sets of sizes a and b have Jaccard similarity 0.8 or more
exactly if at most (a + b) / 9 shingles stand in one of them only. For each band
of sizes the domain of shingles is split by hash into n1 partitions and each of
these into three; signatures are the subsets of two of the three (n2 = 3, k2 = 1).
Sets of one band, or of its upper neighbour near the edge, use the same split.

Of 3 n1 subsets, a shingle in one set only changes two, a second one in the same
partition the third. So of two sets that differ in at most k shingles, at least
3 n1 - 2 k subsets (k < n1) or 2 n1 - k (else) are equal, and a set needs to sign
only so many that two such choices must meet: 2 k + 1 or n1 + k + 1, the fullest
subsets first, an order that equal subsets have in common. Empty subsets are not
signed; a set that lacks some for that also signs its first shingles in hash order,
for pairs of two such sets.

Groups of one signature are never paired with themselves. In rounds, every class
is compared with one leader among its groups: the one met most often, later others.
Groups that still span several components are split further: the shingles of their
members are counted, and a set goes on only with its rarest shingles, as many as a
partner of a given size must share, by size and position. Sets with too many
shingles of their own have no partner and end there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .components import components

WORDS, NUM, DEN = 5, 80, 100
#: n2: cells of a partition, of which subsets leave out one (k2 = 1).
CELLS = 3
#: Partitions of a split beyond the fewest: 2, and one in 50. Their subsets make up for empty ones.
SPARE, SPARE_PART = 2, 50
#: Rounds against leaders: at most so many, fewer if a round's links are under this part of its pairs.
MAX_ROUNDS, FEW_LINKS = 3, 0.05
#: Sizes of sets fall into steps of this ratio where groups are split.
STEP_RATIO = 1.05
#: Classes that a task remembers as signed already, and so many classes of a batch with one signature form a group of their own.
SEEN, GATHER = 500_000, 8
NAMES = ["key", "cls", "doc_id", "n"]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hash of each word seen, as a signed number; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        made = xxhash.xxh3_64_intdigest(word)
        made = self[word] = made - (made >> 63 << 64)
        return made


def shingles(text: str | None, known: Words, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z lower-cased; with fewer words, of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out *= _STEP
        out += h[i : len(h) - width + 1 + i]
    return np.unique(mix(out))


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most shingles that stand in one only of two similar sets of sizes a and b."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def partitions(band: np.ndarray) -> np.ndarray:
    """n1 of the split for sets whose size has ``band`` + 1 binary digits."""
    top = 2 ** (band + 1) - 1
    return differ(top, top * DEN // NUM) // 2 + 1 + SPARE + differ(top, top) // (2 * SPARE_PART)


def signatures(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The signatures of each set. Sets that are similar to equal sets only have none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    least = -(-sizes * NUM // DEN)
    edge = 2**band - 1  # the largest size of the band below
    out: list[list[np.ndarray]] = [[] for _ in sets]
    poor = np.zeros(len(sets), bool)
    own = np.flatnonzero(differ(sizes, sizes * DEN // NUM) > 0)
    lower = np.flatnonzero((least <= edge) & (sizes > 0))
    for who, at, k in ((own, band[own], differ(sizes[own], sizes[own] * DEN // NUM)), (lower, band[lower] - 1, differ(sizes[lower], edge[lower]))):
        if not len(who):
            continue
        n1 = partitions(at)
        first = np.concatenate([[0], np.cumsum(n1)]) * CELLS
        total = int(first[-1])
        all_of = np.concatenate([sets[i] for i in who])
        doc = np.repeat(np.arange(len(who)), sizes[who])
        salt = mix(at.astype(np.uint64) + np.uint64(0x51ED270B))
        cell = first[doc] + (mix(all_of ^ salt[doc]) % (n1 * CELLS)[doc].astype(np.uint64)).astype(np.int64)
        body = mix(all_of + salt[doc])
        # Sums of 32-bit halves stay exact in doubles for up to 2^21 shingles a cell.
        low = np.bincount(cell, weights=(body & _LOW).astype(np.float64), minlength=total).astype(np.uint64)
        high = np.bincount(cell, weights=(body >> np.uint64(32)).astype(np.float64), minlength=total).astype(np.uint64)
        inside = low + (high << np.uint64(32)) + (high >> np.uint64(32)) * _M1
        count = np.bincount(cell, minlength=total)
        # Subset j of a partition is all its cells but cell j.
        rest = lambda x: (x.reshape(-1, CELLS).sum(1, dtype=x.dtype)[:, None] - x.reshape(-1, CELLS)).ravel()
        of = np.repeat(np.arange(len(who)), n1 * CELLS)
        place = (np.arange(total) - first[of]).astype(np.uint64)
        sig, count = mix(mix(rest(inside)) + mix(place ^ (salt[of] << np.uint64(1)))), rest(count)
        needed = np.where(k < n1, 2 * k + 1, n1 + k + 1)
        order = np.lexsort((((np.uint64(255) - np.minimum(count, 255).astype(np.uint64)) << np.uint64(56)) | (sig >> np.uint64(8)), of))
        keep = (place < needed[of].astype(np.uint64)) & (count[order] > 0)  # ``of`` and ``place`` of the ordered rows are the same arrays
        chosen, by = sig[order][keep], of[keep]
        ends = np.searchsorted(by, np.arange(len(who) + 1))
        for d, i in enumerate(who):
            out[i].append(chosen[ends[d] : ends[d + 1]])
            poor[i] |= ends[d + 1] - ends[d] < needed[d]
    for i in np.flatnonzero(poor):
        out[i].append(mix(np.sort(mix(sets[i] ^ np.uint64(0x0BADC0DE)))[: sizes[i] - least[i] + 1] + np.uint64(77)))
    return [np.unique(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in out]


def class_of(s: np.ndarray) -> int | None:
    """Hash of a set, as a signed number; null for an empty one."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes(), len(s)), np.uint64).view(np.int64)) if len(s) else None


def describe(docs: DataFrame) -> DataFrame:
    """(key, cls, doc_id, n) of two kinds, from one reading of the texts.

    A row of each document, n its set's size, cls the set's hash, null for an empty
    set; key is any number. And rows with null n: class cls has signature key. A task
    signs a class with the first row it sees of it, so copies, however many, add
    rows once a task. Where many classes of a batch have a signature, they form a
    group of their own under a key of the batch, and only one class of the task goes
    into the signature's group: groups meet through it, see ``cluster``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, stand_in = Words(), set(), {}
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # parts of a bounded number of shingles
                sets, size = [], 0
                for text in batch.column(1).slice(at, 512):
                    sets.append(shingles(text.as_py(), known))
                    size += len(sets[-1])
                    if size > 500_000:
                        break
                ids, cls, fresh = batch.column(0).slice(at, len(sets)), [class_of(s) for s in sets], []
                at += len(sets)
                if len(seen) > SEEN or len(stand_in) > SEEN:
                    seen.clear()
                    stand_in.clear()
                for i, (c, has_id) in enumerate(zip(cls, ids.is_valid().to_pylist(), strict=True)):
                    if c is not None and has_id and c not in seen:
                        seen.add(c)
                        fresh.append(i)
                n = pa.array([len(s) for s in sets], pa.int32())
                spread = mix(np.arange(len(sets), dtype=np.uint64) + np.uint64(len(seen))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(cls, pa.int64()), ids, n], names=NAMES)
                if not fresh:
                    continue
                sigs = signatures([sets[i] for i in fresh])
                of = np.repeat(np.array([cls[i] for i in fresh], np.int64), [len(x) for x in sigs])
                key, of = gathered(np.concatenate(sigs), of, stand_in)
                nulls = lambda kind: pa.nulls(len(key), kind)  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(of), nulls(pa.int64()), nulls(pa.int32())], names=NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "key long, cls long, doc_id long, n int")


def gathered(key: np.ndarray, of: np.ndarray, stand_in: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (signature, class) of a batch with frequent signatures' rows under keys of the batch, each with the one class that stands for them."""
    found, where, count = np.unique(key, return_inverse=True, return_counts=True)
    frequent = count >= GATHER
    if not frequent.any():
        return key, of
    often = frequent[where]
    batch = mix(of[:1].view(np.uint64) + np.uint64(0x7F4A7C15))
    first = dict(zip(key[often][::-1].tolist(), of[often][::-1].tolist(), strict=True))
    new = [k for k in first if k not in stand_in]
    stand_in.update((k, first[k]) for k in new)
    whole = np.array(list(first), np.uint64)
    # A batch's group has its members and the class that stands in for them, which the task's first such batch put under the signature itself.
    keys = [key[~often], mix(key[often] ^ batch), mix(whole ^ batch), np.array(new, np.uint64)]
    classes = [of[~often], of[often], np.array([stand_in[k] for k in first], np.int64), np.array([first[k] for k in new], np.int64)]
    return np.concatenate(keys), np.concatenate(classes)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sets have Jaccard similarity NUM / DEN or more, on the sets themselves.

    ``texts``: (cls, text) of one document per class. b's text is fetched first; then
    the rows meet a's text, whose hot keys adaptive execution splits. Where an id has
    several texts, only that of the class counts.
    """
    with_b = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, key = Words(), None, None
        for batch in batches:
            keep = []
            # One text at a time leaves the batch's buffers; that of a hot leader once.
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != a:
                    held = shingles(batch.column(2)[i].as_py(), known)
                    key = a if class_of(held) == a else None
                other = shingles(batch.column(3)[i].as_py(), known)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(key == a and class_of(other) == b and DEN * common >= NUM * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(task, "a long, b long")


def rare_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components among ``members`` (cls, n, root) that sizes and rarest shingles don't rule out.

    Shingles are ordered by how many members hold them. Similar sets of sizes n >= m
    share at least (n + m) * NUM / (NUM + DEN) shingles, so the first one they share
    stands early in both; how early depends on n and m. Rows are (shingle, step of m):
    the smaller set gives its own step, the larger one those its position allows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for i, cls in enumerate(batch.column(0).to_pylist()):
                s = shingles(batch.column(1)[i].as_py(), known)
                if class_of(s) == cls:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), cls)), pa.array(s.view(np.int64))], names=["cls", "h"])

    rows = cut(texts.join(members.select("cls"), "cls", "left_semi").select("cls", "text").mapInArrow(task, "cls long, h long"), "member-shingles")
    shared = rows.groupBy("h").agg(F.count("*").alias("f")).filter("f > 1")
    held = rows.join(shared, "h").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("held"))  # a document's own shingles
    least = lambda n: -F.floor(-(n * NUM) / DEN)
    # Shingles of its own come first; they take ``own`` positions.
    listed = held.join(members, "cls").withColumn("own", F.col("n") - F.size("held"))
    listed = listed.withColumn("first", F.greatest(F.lit(0), (F.col("n") - least(F.col("n")) + 1 - F.col("own")).cast("int"))).filter("first > 0")
    placed = listed.select("cls", "root", "n", "own", F.posexplode(F.expr("slice(held, 1, first)")).alias("at", "x"))
    placed = placed.select("cls", "root", "n", F.col("x.h").alias("h"), (F.col("own") + F.col("at") + 1).alias("p"))
    placed = cut(placed, "rare-shingles")
    step = lambda n: F.floor(F.log(n.cast("double")) / F.lit(float(np.log(STEP_RATIO)))).cast("int")
    overlap = lambda n, m: -F.floor(-((n + m) * NUM) / (NUM + DEN))
    n, p = F.col("n"), F.col("p")
    small = placed.filter(p <= n - overlap(n, n) + 1).select("h", step(n).alias("step"), F.col("cls").alias("b"), F.col("root").alias("rb"), n.alias("nb"), p.alias("pb"))
    most = F.least(n, F.floor((n - p + 1) * (NUM + DEN) / NUM) - n)
    large = placed.filter(most >= least(n)).select("h", F.explode(F.sequence(step(least(n)), step(most))).alias("step"), F.col("cls").alias("a"), F.col("root").alias("ra"), n.alias("na"), p.alias("pa"))
    # Groups of one component have nothing to find; nor have those with one member.
    spans = small.select("h", "step", F.col("rb").alias("r")).unionByName(large.select("h", "step", F.col("ra").alias("r"))).groupBy("h", "step").agg(F.min("r").alias("x"), F.max("r").alias("y")).filter("x <> y").select("h", "step")
    na, nb, pa_, pb = F.col("na"), F.col("nb"), F.col("pa"), F.col("pb")
    fits = (F.col("ra") != F.col("rb")) & (nb >= least(na)) & ((na > nb) | ((na == nb) & (F.col("a") > F.col("b")))) & (overlap(na, nb) <= 1 + F.least(na - pa_, nb - pb))
    met = small.join(spans, ["h", "step"], "left_semi").alias("s").join(large.alias("l"), (F.col("s.h") == F.col("l.h")) & (F.col("s.step") == F.col("l.step")) & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def at_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with column cls and the root of its component; a class without links is its own."""
    return rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def spanning(groups: DataFrame, roots: DataFrame, weight: Column) -> tuple[DataFrame, DataFrame]:
    """(sig, cls, w, root) of the groups that hold several components, and the leader of each: the member of most ``weight``."""
    rooted = at_roots(groups, roots)
    led = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("top"), F.max(F.struct(weight.alias("by"), F.col("cls"), F.col("root"))).alias("leader")).filter("low <> top").select("sig", "leader")
    return rooted.join(led.select("sig"), "sig", "left_semi"), led


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text).

    A row without words links with nothing; its component is its own id. A row
    without id has no component. Rows that repeat an id are one document: what any
    of them links to, all do.
    """
    by_key, signer = W.partitionBy("key"), F.when(F.col("n").isNull(), F.col("cls"))
    met = {"low": F.min(signer), "top": F.max(signer), "all": F.sum(F.shiftrightunsigned(F.xxhash64(signer), 36)), "size": F.count(signer)}
    # Of the rows of signatures, only groups of several classes stay.
    stored = cut(describe(docs).withColumns({k: v.over(by_key) for k, v in met.items()}).filter("n is not null or low <> top"), "shingle-sets")
    described = stored.filter("n is not null").select("doc_id", "cls", F.col("n").cast("long").alias("n"))
    linkable = described.filter("cls is not null and doc_id is not null")
    classes = cut(linkable.groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")), "shingle-classes")
    # Sets that one id holds are linked through the least of them.
    repeats = linkable.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("top")).filter("a <> top")
    links = cut(linkable.select("doc_id", F.col("cls").alias("b")).join(repeats, "doc_id").filter("a <> b").select("a", "b").distinct(), "same-id-links")
    # Groups of the same classes say the same: of each set of members one stays, named by a hash of the set. Where
    # two sets had the same hash they would be one group, which only adds pairs to look at.
    groups = stored.filter("n is null").select(F.xxhash64("low", "top", "all", "size").alias("sig"), "cls", "size").distinct()
    groups = cut(groups, "signature-groups")
    weights = groups.groupBy("cls").agg(F.sum("size").alias("w"))
    groups = cut(groups.join(weights, "cls").select("sig", "cls", "w"), "weighed-groups")
    ids = classes.join(groups.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("least").alias("doc_id"))
    texts = cut(ids.join(docs.select("doc_id", "text"), "doc_id").select("cls", "text"), "met-texts")
    roots, tried, number, split = components(links), None, 0, False
    while not split:
        # Everyone against one leader: at first that with most company, then one by a hash that changes from round to round.
        open_groups, led = spanning(groups, roots, F.col("w") if not number else F.xxhash64("cls", F.lit(number)))
        split = number == MAX_ROUNDS or (number > 0 and n_links < FEW_LINKS * n_pairs)
        if split:
            # All classes of the components there: a signature's groups meet through one class of each.
            open_roots, rooted = open_groups.select("root").distinct(), at_roots(groups.select("cls").distinct(), roots)
            members = rooted.join(open_roots, "root", "left_semi").join(classes.select("cls", "n"), "cls").select("cls", "n", "root")
            pairs = rare_pairs(cut(members, "open-classes"), texts)
        else:
            choice = open_groups.join(led, "sig").filter("root <> leader.root").groupBy("cls").agg(F.max("leader").alias("leader"))
            pairs = choice.select(F.least("cls", "leader.cls").alias("a"), F.greatest("cls", "leader.cls").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        checked = cut(pairs, f"near-pairs-{number}")
        tried = checked if tried is None else tried.unionByName(checked)
        found = cut(verify(checked, texts), f"near-links-{number}")
        n_pairs, n_links, number = checked.count(), found.count(), number + 1
        if n_links:
            links = links.unionByName(found)
            roots = components(links)
        if not n_pairs:
            break
    placed = at_roots(classes, roots)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = placed.select("cls", "root").join(named, "root").select("cls", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return described.join(of_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
