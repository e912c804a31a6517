"""Near-duplicate documents by BagMinHash (operator 10).

A document is a bag of shingles of five words with their numbers of occurrences as weights; the
similarity of two is the weighted Jaccard similarity (sum of minima by sum of maxima).

Signatures.  The weight scale is cut into octaves (0, 1], (1, 2], (2, 4], ...; each octave of each
shingle has a Poisson process of points (time, level in the octave, register) that depends on the
shingle and the octave alone.  A shingle of weight w has the processes of the octaves below w; the
octave that w cuts is thinned by the points' levels.  A register keeps the least time it meets, so two
documents agree in a register with the probability of their weighted Jaccard similarity.  Points come
in order of time and a process ends once it is later than the document's latest register, which takes
a nearly constant number of points for each document.  All documents of a batch advance together.

Candidates and links.  A text is known by 128 bits of its digest, so equal texts are one from the
start.  Signatures are cut into bands; texts that share a band are a bucket, and buckets with the same
members are one.  A bucket's texts meet in one task, which compares each pair in the first band that
the pair shares: by signature, then exactly by their words, unless earlier links connect them already;
it gives links, a forest, not pairs.  Buckets larger than ``block`` texts are dealt into blocks by
hash and each two blocks meet in a task of their own, so no task holds more than two blocks and no
pair is lost (a long text counts as one for each ``LONG`` shingles, so a task's memory doesn't grow with
the length of the texts; where the shingles of a bucket are too many to be kept as words, hashes of them,
by which two texts are never less similar, tell first which pairs are compared by words); before that, the members of such buckets are linked to the bucket's least text where
they are similar, and buckets that are one component by then are done.  Blocks compare signatures
first, without texts; texts follow only for members whose signature is near another one's.  Components
come from repeated large-star and small-star steps on written tables.

Common texts, hubs and classes are dealt over tasks: a text counts once for each task that reads it, and
the members of a hub or class meet what is known of it by key and share (``spread``).

A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands: at 0.8 with 32 bands of
6 rows 0.99994.  Pairs of which the signatures agree in fewer registers than five standard deviations
below the threshold allow aren't compared word by word.

Defined results: texts of fewer than five words are one shingle of all their words; texts without
a word (and nulls) are classes of their own: their class is their id.  A null id is a row like any
other; a class of null ids only is null.  Repeated rows are exact copies of each other.  An empty table
gives an empty result; texts of any length are signed and compared whole.  Only the id and the text are
read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import FEW, batches, out_batch, share, spread, table, with_facts, written

WORDS, BANDS, ROWS, THRESHOLD = 5, 32, 6, 0.8

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(10).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    if len(_POWERS.get(int(base), ())) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        _POWERS[int(base)] = np.multiply.accumulate(out)
    return _POWERS[int(base)][:n]


def _times(k: int) -> np.uint64:
    return np.uint64(int(_GOLDEN) * k & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of texts: document number, hash and count of each distinct shingle, in order of both."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not texts:
        return none
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    inside = ~_BLANKS[data]
    change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    at, stop = change[::2], change[1::2]
    if not len(at):
        return none
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_STEP, len(data)), out=sums[1:])
    word = mix((sums[stop] - sums[at]) * _power(_STEP_BACK, len(data))[at] + (stop - at).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.searchsorted(ends, at, side="right")
    sizes = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    number = np.where(sizes > 0, np.maximum(sizes - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), number)
    start = np.repeat(first - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
    value = np.full(len(owner), words, np.uint64)
    left = np.repeat(first + sizes, number) - start
    for k in range(words):
        w = word[np.minimum(start + k, len(word) - 1)]
        value = mix(value * _STEP + np.where(left > k, w, np.uint64(0)))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], value[new], np.diff(np.append(new, len(value)))


def signatures(owner: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, size: int) -> np.ndarray:
    """BagMinHash registers (n x size, float64) of documents given as bags of shingles."""
    least = np.full(n * size, np.inf)
    # processes by octave: (lower, upper] is relevant to all weights above lower
    docs, seeds, rates, limits = [owner], [mix(value ^ _GOLDEN)], [np.ones(len(owner))], [np.ones(len(owner))]
    lower, octave = 1, 1
    more = np.flatnonzero(count > lower)
    while len(more):
        docs.append(owner[more])
        seeds.append(mix(value[more] ^ _times(2 * octave + 1)))
        rates.append(np.full(len(more), float(lower)))
        limits.append(np.minimum(1.0, (count[more] - lower) / lower))
        lower, octave = 2 * lower, octave + 1
        more = more[count[more] > lower]
    doc, seed, rate, limit = map(np.concatenate, (docs, seeds, rates, limits))
    time, k = np.zeros(len(doc)), 0
    while len(doc):
        k += 1
        draw = mix(seed + _times(k))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        mark = mix(draw ^ _STEP)
        register = ((mark & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
        counts = (mark >> np.uint64(32)).astype(np.float64) * 2.0**-32 < limit
        at = doc * size + register.astype(np.int64)
        np.minimum.at(least, at[counts], time[counts])
        latest = least.reshape(n, size).max(1)
        on = time < latest[doc]
        doc, seed, rate, limit, time = doc[on], seed[on], rate[on], limit[on], time[on]
    return least.reshape(n, size)


def similarity(a: str, b: str, words: int = WORDS) -> float:
    """Weighted Jaccard similarity of two texts' bags of shingles, by the words themselves."""
    x, y = bag(a, words), bag(b, words)
    return _jaccard(x, y)


def _words(text: str) -> list[str]:
    return [w for w in text.translate(_TO_BLANK).split(" ") if w]


_TO_BLANK = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def bag(text: str, words: int = WORDS) -> Counter:
    w = _words(text)
    if not w:
        return Counter()
    return Counter(zip(*(w[k:] for k in range(words)))) if len(w) >= words else Counter([tuple(w)])


def _jaccard(x: Counter, y: Counter) -> float:
    if len(y) < len(x):
        x, y = y, x
    shared = sum(min(n, y[s]) for s, n in x.items() if s in y)
    total = x.total() + y.total() - shared
    return shared / total if total else 0.0


SIGNED = "_v_id long, tid binary, size long, bands array<long>, sketch binary"
_SIGNED = pa.schema([("_v_id", pa.int64()), ("tid", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
#: How many digests a task remembers; a text that it has forgotten is signed again, with the same result.
_REMEMBERED = 1 << 16
#: Buckets of more texts than this are kept out of the shuffle by bucket.
HOT = 10_000
#: Shingles of a text that count as one text in the size of a bucket, and shingles that a bucket keeps at a time.
LONG, KEPT = 4096, 200_000


def sign(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each text; and for its first row in a task its number of shingles, band keys and one byte
    of each register.  Texts without a word have no digest."""
    size = bands * rows

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch, texts in batches(source, "text", 1_000_000):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            tids = [hashlib.sha256(x).digest()[:16] for x in raw]
            if len(seen) > _REMEMBERED:
                seen.clear()
            fresh = [i for i, t in enumerate(tids) if t not in seen and not seen.add(t)]
            owner, value, count = shingles([raw[i] for i in fresh], words)
            folded = mix(signatures(owner, value, count, len(fresh), size).view(np.uint64))
            key = np.zeros((len(fresh), bands), np.uint64)
            for r in range(rows):
                key = mix(key * _STEP + folded[:, r::rows])
            key = mix(key + np.arange(bands, dtype=np.uint64) * _GOLDEN).view(np.int64)
            total = np.bincount(owner, count, len(fresh)).astype(np.int64)
            low = (folded >> np.uint64(56)).astype(np.uint8)
            own: list[tuple] = [(0, None, None)] * len(raw)
            for i, n, k, x in zip(fresh, total.tolist(), key, low):
                if n:
                    own[i] = (n, k.tolist(), x.tobytes())
            sizes, keys, sketches = zip(*own)
            worded = [bool(_WORD.search(x)) for x in raw]
            yield out_batch(
                _SIGNED, {"_v_id": batch.column(0), "tid": [t if w else None for t, w in zip(tids, worded)], "size": list(sizes), "bands": list(keys), "sketch": list(sketches)}
            )

    return docs.select(F.col(id_col).cast("long").alias("_v_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SIGNED)


_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for the nodes of undirected ``edges`` (a, b): the least node that is connected.
    Nodes that are their own root have no row.

    Large-star and small-star steps in turn until a step changes nothing; a node with very many
    neighbours is handled by an aggregate and a join by node and share of the neighbours, never as one group.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = spread(both, least, ["a"], ["b"])
        out = met.filter("b > a").select(F.col("b").alias("x"), "m") if large else met.select(F.explode(F.array("a", "b")).alias("x"), "m")
        return out.filter("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name)
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if row[0] == 0 or row == mark:
            break
        mark = row
        now = written(star(star(now, True), False), name)
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def _near(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of rows (a, b, sketch_a, sketch_b) whose signatures agree in ``least`` registers."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            near = (x == y).sum(1) >= least
            yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=_LINKS).filter(pa.array(near))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a binary, b binary")


def _linked(pairs: DataFrame, texts: DataFrame, least: int, threshold: float, words: int) -> DataFrame:
    """Those of the pairs (a, hub b) that are as similar as the threshold.

    A hub's members are dealt into shares; each share meets one copy of the hub's text, which comes first."""
    sketch = lambda x: texts.select(F.col("tid").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    near = written(_near(spread(pairs.join(sketch("a"), "a"), sketch("b"), ["b"], ["a"]), least).withColumn("share", share("a")), "near")
    text = lambda x: texts.select(F.col("tid").alias(x), "text")
    members = near.join(text("a"), "a").select("b", "share", F.lit(1).alias("role"), "a", "text")
    hubs = near.select("b", "share").distinct().join(text("b"), "b").select("b", "share", F.lit(0).alias("role"), F.col("b").alias("a"), "text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for part in (batch.slice(k, 256) for batch in source for k in range(0, batch.num_rows, 256)):
            found = []
            for b, role, a, text in zip(*(c.to_pylist() for c in part.columns)):
                if not role:
                    hub = bag(text, words)
                elif _jaccard(hub, bag(text, words)) >= threshold:
                    found.append((a, b))
            if found:
                yield out_batch(_LINKS, dict(zip("ab", zip(*found))))

    dealt = members.unionByName(hubs).repartition("b", "share").sortWithinPartitions("b", "share", "role", "a")
    return dealt.select("b", "role", "a", "text").mapInArrow(run, "a binary, b binary")


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class _Bucket:
    """The texts of a bucket (or of two blocks of one) in a task, and the links among them."""

    def __init__(self, rows: list[tuple], least: int, threshold: float, words: int):
        known: dict[bytes, tuple] = {}
        for row in rows:
            known.setdefault(row[0], row)
        self.tids = list(known)
        _, self.roots, sizes, sides, places, bands, sketches, self.texts = map(list, zip(*known.values()))
        self.sizes = np.array(sizes)
        self.sides = np.array(sides)
        self.cross = len(set(sides)) > 1
        self.place = places[0]
        self.bands = np.array([b[: self.place] for b in bands], np.int64).reshape(len(bands), self.place)
        self.sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
        self.least, self.threshold, self.words = least, threshold, words
        self.parent: dict[bytes, bytes] = {}
        self.bags: dict[int, Counter] = {}
        self.kept = 0
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.many = self.sizes.sum() > KEPT

    def find(self, x: bytes) -> bytes:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def bag(self, i: int) -> Counter:
        """The i-th text's shingles; those used longest ago go once there are more than ``KEPT``."""
        found = self.bags.pop(i, None)
        if found is None:
            found = bag(self.texts[i], self.words)
            self.kept += len(found)
        self.bags[i] = found
        while self.kept > KEPT and len(self.bags) > 1:
            self.kept -= len(self.bags.pop(next(iter(self.bags))))
        return found

    def hashed(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the i-th text's shingles in order, and how often each is there."""
        if i not in self.hashes:
            self.hashes[i] = shingles([self.texts[i].encode("utf-8", "surrogatepass")], self.words)[1:]
        return self.hashes[i]

    def alike(self, i: int, j: int) -> bool:
        """Whether two texts are as similar as the threshold, by their words."""
        if self.many:
            # shingles that share a hash only add to what is shared, so no pair is lost
            (x, n), (y, m) = self.hashed(i), self.hashed(j)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            same = x[at] == y
            shared = int(np.minimum(n[at[same]], m[same]).sum())
            if shared / (int(n.sum()) + int(m.sum()) - shared) < self.threshold:
                return False
        return _jaccard(self.bag(i), self.bag(j)) >= self.threshold

    def near(self, i: int) -> np.ndarray:
        """Which of the texts before the i-th are compared with it here, and are near by their signatures."""
        near = (self.sketches[:i] == self.sketches[i]).sum(1) >= self.least
        small, large = np.minimum(self.sizes[:i], self.sizes[i]), np.maximum(self.sizes[:i], self.sizes[i])
        near &= small >= self.threshold * large
        if self.cross:
            near &= self.sides[:i] != self.sides[i]
        if self.place:
            near &= ~(self.bands[:i] == self.bands[i]).any(1)
        return near

    def candidates(self) -> Iterator[bytes]:
        """The texts that are near one of another component."""
        flagged = np.zeros(len(self.tids), bool)
        names: dict[bytes, int] = {}
        roots = np.array([names.setdefault(r, len(names)) for r in self.roots])
        for i in range(1, len(self.tids)):
            near = self.near(i) & (roots[:i] != roots[i])
            flagged[:i] |= near
            flagged[i] |= near.any()
        return (t for t, f in zip(self.tids, flagged) if f)

    def links(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(1, len(self.tids)):
            for j in np.flatnonzero(self.near(i)).tolist():
                x, y = self.find(self.roots[i]), self.find(self.roots[j])
                if x != y and self.alike(i, j):
                    self.parent[max(x, y)] = min(x, y)
                    yield self.tids[i], self.tids[j]


_KEYS = ["key", "p", "q"]
_MEMBER = ["tid", "root", "size", "side", "place", "bands", "sketch", "text"]


def _by_bucket(rows: DataFrame, schema: str, found: Callable[[tuple, list[tuple]], pa.RecordBatch | None]) -> DataFrame:
    """``found`` for the members of each (key, p, q), one bucket (or two blocks of one) at a time."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for part in (batch.slice(k, 256) for batch in source for k in range(0, batch.num_rows, 256)):
            for key, p, q, *row in zip(*(c.to_pylist() for c in part.columns)):
                if (key, p, q) != current:
                    if len(held) > 1 and (out := found(current, held)):
                        yield out
                    current, held = (key, p, q), []
                if not held or held[-1][0] != row[0]:
                    held.append(tuple(row))
        if len(held) > 1 and (out := found(current, held)):
            yield out

    return rows.select(*_KEYS, *_MEMBER).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "tid").mapInArrow(run, schema)


def _bucket_links(rows: DataFrame, least: int, threshold: float, words: int) -> DataFrame:
    def found(_: tuple, held: list[tuple]) -> pa.RecordBatch | None:
        links = list(_Bucket(held, least, threshold, words).links())
        return out_batch(_LINKS, dict(zip("ab", zip(*links)))) if links else None

    return _by_bucket(rows, "a binary, b binary", found)


def _bucket_candidates(rows: DataFrame, least: int, threshold: float, words: int) -> DataFrame:
    """(key, p, q, tid) of the members that are near another one by their signatures; no texts are needed."""
    schema = pa.schema([("key", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("tid", pa.binary())])

    def found(where: tuple, held: list[tuple]) -> pa.RecordBatch | None:
        tids = list(_Bucket(held, least, threshold, words).candidates())
        return out_batch(schema, {"key": [where[0]] * len(tids), "p": [where[1]] * len(tids), "q": [where[2]] * len(tids), "tid": tids}) if tids else None

    return _by_bucket(rows.withColumn("text", F.lit(None).cast("string")), "key long, p int, q int, tid binary", found)


def digest(text_col: str = "text") -> Column:
    """The 128 bits by which a text is known (``tid``)."""
    return F.unhex(F.substring(F.sha2(F.col(text_col).cast("string").cast("binary"), 256), 1, 32))


def rooted(
    docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = 1024
) -> DataFrame:
    """(_v_id, tid, root) of each row: its text and the text that stands for its class (nulls without a word)."""
    size = bands * rows
    least = max(0, math.floor(size * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / size))))
    signed = written(sign(docs, words, bands, rows, id_col, text_col), "signed")
    facts = signed.filter("bands is not null")
    weight = F.ceil(F.col("size") / F.lit(LONG)).cast("int").alias("weight")
    banded = facts.select("tid", weight, F.posexplode("bands").alias("place", "key"))
    # most keys are of one text: they are counted alone first, and only the members of others are told apart
    counts = written(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    shared = written(_members(banded, counts).drop("n"), "shared")
    mark = lambda *salt: F.sum(F.xxhash64("tid", *salt).cast("decimal(38,0)"))
    buckets = shared.groupBy("key").agg(F.sum("weight").alias("n"), F.min("tid").alias("low"), F.max("tid").alias("high"), mark().alias("all"), mark(F.lit(1)).alias("also"), F.min("place").alias("place"))
    buckets = buckets.filter("low != high").groupBy("n", "low", "high", "all", "also").agg(F.min(F.struct("place", "key")).alias("k"))
    buckets = written(buckets.select("k.key", "k.place", "n", "low"), "buckets")
    held = written(_members(shared.select("tid", "key"), buckets), "held")
    # a common text is dealt by the ids of its rows, and is one row of each share; texts are joined alike at every size
    ids = held.select("tid").distinct()
    rows_ = docs.select(digest(text_col).alias("tid"), share(id_col).alias("_share"), F.col(text_col).cast("string").alias("text"))
    asked = rows_.select("tid", "_share").distinct().join(ids, "tid", "left_semi")
    texts = rows_.join(asked.hint("merge"), ["tid", "_share"], "left_semi").dropDuplicates(["tid"]).select("tid", "text")
    told = facts.select("tid", "size", "bands", "sketch").join(ids, "tid", "left_semi").dropDuplicates(["tid"])
    texts = written(texts.join(told, "tid"), "texts")

    links = None
    most = held.agg(F.max("n")).first()[0] or 0
    held = held.withColumn("root", F.col("tid"))
    if most > block:
        pairs = held.filter((F.col("n") > block) & (F.col("low") != F.col("tid"))).select(F.col("tid").alias("a"), F.col("low").alias("b")).distinct()
        links = written(_linked(pairs, texts, least, threshold, words), "links")
        to = components(links, "starred")
        held = held.drop("root").join(to, held["tid"] == to["node"], "left").withColumn("root", F.coalesce("root", "tid")).drop("node")
        open_ = held.groupBy("key").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).filter("_x != _y").select("key")
        held = written(with_facts(held, written(open_, "open"), ["key"], ["tid"]), "open-held")
    member = texts.select("tid", "size", "bands", "sketch")
    small = held.filter(F.col("n") <= block).select("key", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), "tid", "root", "place")
    found = written(_bucket_links(small.join(texts.hint("merge"), "tid"), least, threshold, words), "links")
    if most > block:
        # blocks of large buckets: a member goes to the tasks of its own block with each block
        n_blocks = F.ceil(F.col("n") * 2 / block).cast("int")
        large = held.filter(F.col("n") > block).withColumn("blocks", n_blocks).withColumn("side", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
        dealt = large.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("side", "_o").alias("p"), F.greatest("side", "_o").alias("q"), "side", "tid", "root", "place")
        asked = written(_bucket_candidates(dealt.join(member, "tid"), least, threshold, words), "asked")
        chosen = dealt.join(asked, [*_KEYS, "tid"], "left_semi")
        found = found.union(written(_bucket_links(chosen.join(texts, "tid"), least, threshold, words), "links"))
        found = found.union(links)
    root = components(found).withColumnRenamed("node", "tid")

    told = spread(signed.select("_v_id", "tid").filter("tid is not null"), root, ["tid"], ["_v_id"], "left").select("_v_id", "tid", F.coalesce("root", "tid").alias("root"))
    return told.unionByName(signed.filter("tid is null").select("_v_id", "tid", F.col("tid").alias("root")))


def _members(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (tid, key) with what is known of their buckets (a written table).

    Large buckets are few and broadcast (if they are ``FEW``, which is counted), so only members of small ones
    are shuffled by bucket; beyond, all are joined by bucket and share."""
    large = buckets.filter(F.col("n") > HOT)
    n = large.count()
    if not n:
        return rows.join(buckets, "key")
    if n > FEW:
        return spread(rows, buckets, ["key"], ["tid"])
    known = F.broadcast(large)
    small = rows.join(F.broadcast(large.select("key")), "key", "left_anti").join(buckets.filter(F.col("n") <= HOT), "key")
    return small.unionByName(rows.join(known, "key"))


def near_classes(
    docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = 1024
) -> DataFrame:
    """(doc_id, class_id): the least id of the document's near-duplicate class."""
    grouped = written(rooted(docs, words, bands, rows, threshold, id_col, text_col, block), "grouped")
    classes = grouped.filter("root is not null").groupBy("root").agg(F.min("_v_id").alias("class_id"))
    worded = spread(grouped.filter("root is not null"), classes, ["root"], ["_v_id", "tid"]).select(F.col("_v_id").alias("doc_id"), "class_id")
    return worded.unionByName(grouped.filter("root is null").select(F.col("_v_id").alias("doc_id"), F.col("_v_id").alias("class_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_minhash_near_dedup``: the near-duplicate class of each document."""
    return near_classes(table(spark, sf_dir, "documents"))
