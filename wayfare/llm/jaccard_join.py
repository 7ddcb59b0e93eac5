"""N-gram Jaccard join: near duplicates by shingle sets, as components.

Documents with one shingle set are one node. Two sets with Jaccard similarity num/den or
more share a token among the first n - ceil(n * num / den) + 1 of each, whatever the order
of tokens, so long as it is one order for all (here by hash, tokens of many documents
last). With s more tokens in each prefix, similar sets share s + 1 of them (or all they must
share, if that is less), where s is that of the smaller set: a sixteenth of its size, SHARED at
least. So a set with fewer tokens in common with sets of its size is out at once, and its text
is never moved; this keeps out long texts that share a few shingles with many by chance.

Each prefix token is led by one of the sets that hold it, the one that shares most of its
prefix: near copies of one text resemble it more than each other, so a group has few leads.
A tile holds the sets that have a token of one lead and lie in one band of sizes, with those
of the next smaller band as visitors; similar sets share a token, so they meet in a tile.
There pairs of sets that are not connected yet are judged by size and by hashed bitmap
signatures: each bit is the parity of the tokens that hash to it, so the bits in which two
signatures differ are no more than the tokens in which the sets differ, which bounds the
overlap from above. Pairs that pass are settled by intersecting their sorted arrays.

A group of k mutual near copies must not cost k * k pairs. So sets are first dealt out by
the lead they share most with, in chunks of bounded size that each hold the lead too, and
linked within the chunk. Then two passes over the tiles look only at what lies in different
components: the first judges the LINKS likeliest partners of each set, the second (where any
set has more) all pairs that are still apart. In a tile the largest component is never compared with itself.
Tiles over TILE rows are dealt into blocks, one cell for each pair of blocks.

Defined cases. Null text, or one of blanks: no shingles, linked with nothing,
component its own doc_id. Rows are linked by text, so repeated rows and rows that
share a doc_id are linked with each other when their sets are; null doc_ids are
ignored when the smallest is taken. Equal similarity to the bound links. Node ids are
64-bit digests of the whole sorted set. doc_id must be whole numbers (it is cast to long).
Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import digest
from wayfare.llm.textwords import chunks, shingle_sets
from wayfare.operators.graph import connected_components
from wayfare.scratch import write_table

#: Shingles counted together when looking for tokens of many documents, the count from
#: which such a chunk reports one, and the most reports that tasks are told of (8 bytes
#: each). These shape the order of tokens alone.
COUNT_CHUNK, REPORT, FREQUENT = 2_000_000, 8, 100_000
#: Tokens by which a prefix is longer than it must be: a part of the set's size, and some at least.
SHARED, SHARED_PART = 4, 16
LINKS = 3
#: Rows of a block of a tile, bytes of its signatures, tokens of a chunk.
TILE, TILE_BYTES, CHUNK_TOKENS = 8_000, 1 << 24, 1 << 18
#: Bits of a signature for each token, and the least and most of them (powers of two).
BITS_PER_TOKEN, LEAST_BITS, MOST_BITS = 2, 512, 1 << 14
#: Sets compared at once: words of 64 bits.
AT_ONCE = 1 << 22


def _ceil(n, num: int, den: int):
    return -(-n * num // den)


def _more(n: int) -> int:
    """Tokens by which the prefix of a set of n is longer than it must be."""
    return max(SHARED, n // SHARED_PART)


def _sid(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for words in chunks(batch.column("text")):
        yield from zip(words.rows, shingle_sets(words, k), strict=True)


def _features(k: int):
    """(kind 0: doc_id, digest of the text, sid, n), (kind 1: a frequent token and its count)."""
    names = ["kind", "doc_id", "h", "sid", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            token, count = token[count >= REPORT].view(np.int64), count[count >= REPORT]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.binary()), pa.array(token), pa.array(count)], names)

        for batch in batches:
            sid, n = [], []
            for _, tokens in _sets(batch, k):
                n.append(len(tokens))
                sid.append(_sid(tokens) if len(tokens) else None)
                if len(tokens) and sid[-1] not in seen:
                    seen.add(sid[-1])
                    held.append(tokens)
                    size += len(tokens)
                    if size >= COUNT_CHUNK:
                        yield flush()
                        held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id").cast(pa.int64()), batch.column("h"), pa.array(sid, pa.int64()), pa.array(n, pa.int64())], names)
        if held:
            yield flush()

    return run


def _ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    late = frequent[at] == tokens
    return np.concatenate([tokens[~late], tokens[late]]) if late.any() else tokens


def _prefixes(k: int, num: int, den: int, frequent):
    """(token, sid, n) for the prefix of each set that the task has not met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = frequent.value, set()
        for batch in batches:
            rows = []
            for _, tokens in _sets(batch, k):
                if not (n := len(tokens)) or (sid := _sid(tokens)) in seen:
                    continue
                seen.add(sid)
                rows.append((sid, n, _ordered(tokens, late)[: n - _ceil(n, num, den) + 1 + _more(n)]))
            if rows:
                size = np.array([len(t) for _, _, t in rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([t for _, _, t in rows]).view(np.int64)),
                        pa.array(np.repeat(np.array([s for s, _, _ in rows], np.int64), size)),
                        pa.array(np.repeat(np.array([n for _, n, _ in rows], np.int32), size)),
                    ],
                    ["token", "sid", "n"],
                )

    return run


def _live(num: int, den: int):
    """Of rows sorted by (token, n, sid): those whose token has another set of a near size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose neighbour is still to come
        last = None  # the row before it: token, size

        def tile(rows: list[np.ndarray], final: bool):
            nonlocal held, last
            token, sid, n = rows
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (sid[1:] == sid[:-1])
            token, sid, n = (x[~same] for x in rows)
            if not final:
                held = [x[-1:] for x in (token, sid, n)]
            end = len(token) if final else len(token) - 1
            if not end:
                return None
            # of the rows of a token, sorted by size, the adjacent ones are nearest in size
            near = np.zeros(len(token), bool)
            near[1:] = (token[1:] == token[:-1]) & (n[:-1].astype(np.int64) * den >= n[1:].astype(np.int64) * num)
            if last is not None and last[0] == token[0] and last[1] * den >= int(n[0]) * num:
                near[0] = True
            alive = near.copy()
            alive[:-1] |= near[1:]
            last = (token[end - 1], int(n[end - 1]))
            return pa.RecordBatch.from_arrays([pa.array(x[:end][alive[:end]]) for x in (token, sid, n)], ["token", "sid", "n"])

        for batch in batches:
            if batch.num_rows:
                rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                if held is not None:
                    rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
                if (out := tile(rows, False)) is not None:
                    yield out
        if held is not None and (out := tile(held, True)) is not None:
            yield out

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by the first `keys` columns, one table for each run of equal keys."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        table = pa.Table.from_batches([batch])
        for lo, hi in zip(np.r_[0, new], np.r_[new, batch.num_rows], strict=True):
            now = tuple(c[lo] for c in cols)
            if held and now != key:
                yield pa.concat_tables(held)
                held = []
            key = now
            held.append(table.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)


def _signature(tokens: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_TOKEN * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _folded(signatures: list[bytes], size: int) -> np.ndarray:
    """Signatures brought to `size` bytes: halves laid on one another keep the parity."""
    out = np.empty((len(signatures), size // 8), np.uint64)
    for i, x in enumerate(signatures):
        row = np.frombuffer(x, np.uint64)
        while len(row) > size // 8:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def _most_apart(total, num: int, den: int):
    """Similar sets of this size together differ in so many tokens at most."""
    return total - 2 * _ceil(total, num, num + den)


def _near(sig: np.ndarray, n: np.ndarray, rows: np.ndarray, among: np.ndarray, apart, num: int, den: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, spare) of pairs that may be similar; apart(i, j) says which pairs to look at.

    spare: by how many tokens they could differ more.
    """
    short = _folded_more(sig, LEAST_BITS // 64)
    step = max(1, AT_ONCE // max(1, len(among) * short.shape[1]))
    for at in range(0, len(rows), step):
        i = rows[at : at + step]
        a, b = n[i, None], n[None, among]
        ok = apart(i[:, None], among[None, :]) & (a * den >= b * num) & (b * den >= a * num)
        if not ok.any():
            continue
        most = _most_apart(a + b, num, den)
        ok &= np.bitwise_count(short[i, None] ^ short[None, among]).sum(2, dtype=np.int64) <= most
        x, y = np.nonzero(ok)
        for part in range(0, len(x), piece := max(1, AT_ONCE // sig.shape[1])):
            p, q = x[part : part + piece], y[part : part + piece]
            spare = most[p, q] - np.bitwise_count(sig[i[p]] ^ sig[among[q]]).sum(1, dtype=np.int64)
            good = spare >= 0
            if good.any():
                yield i[p[good]], among[q[good]], spare[good]


def _folded_more(sig: np.ndarray, width: int) -> np.ndarray:
    while sig.shape[1] > width:
        sig = sig[:, : sig.shape[1] // 2] ^ sig[:, sig.shape[1] // 2 :]
    return sig


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _chunk_links(num: int, den: int):
    """(a, b) that connect what is similar within each chunk: fewer than its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in _groups(batches, 2):
            lead, sid = int(rows["lead"][0].as_py()), rows["sid"].to_numpy()
            _, one = np.unique(sid, return_index=True)
            one = one[np.argsort(sid[one] != lead, kind="stable")]  # the lead first
            sid = sid[one]
            signatures, tokens = rows["sig"].to_pylist(), rows["tokens"].to_pylist()
            tokens = [np.frombuffer(tokens[i], np.uint64) for i in one]
            signatures = [signatures[i] for i in one]
            n = np.array([len(t) for t in tokens], np.int64)
            sig = _folded(signatures, min(map(len, signatures)))
            root = np.arange(len(sid))
            # what the lead links needs no more looking at
            for at in range(len(sid)):
                rest = np.arange(at + 1, len(sid))
                rest = rest[root[rest] != root[at]]
                if not len(rest):
                    continue
                for _, j, spare in _near(sig, n, np.array([at]), rest, lambda i, j: np.ones((i.size, j.size), bool), num, den):
                    for y in j[np.argsort(-spare, kind="stable")]:
                        if root[y] != root[at] and _similar(tokens[at], tokens[y], num, den):
                            found.append((int(sid[at]), int(sid[y])))
                            root[root == max(root[at], root[y])] = min(root[at], root[y])
            if len(found) >= 10_000:
                yield _pairs_batch(found)
                found = []
        if found:
            yield _pairs_batch(found)

    return run


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(pairs, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _cell_pairs(num: int, den: int, links: int | None):
    """(a, b, more) of each cell: sets of different components that may be similar.

    Rows of a cell: odd (not of the tile's largest component) or even, visitors or not, of
    one block or two. Pairs of two even rows, and of two visitors, are not looked at, nor in a cell of two
    odd blocks those of one block. links: so many likeliest partners of each odd row, or all;
    more: the row has others, which are left to a pass without that bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(bool))], ["a", "b", "more"])

        for rows in _groups(batches, 3):
            sid, comp, n = (rows[c].to_numpy() for c in ("sid", "comp", "n"))
            odd, guest, block, mixed = rows["odd"].to_numpy(), rows["guest"].to_numpy(), rows["block"].to_numpy(), rows["mixed"][0].as_py()
            o = np.argsort(~odd, kind="stable")
            sid, comp, n, odd, guest, block = sid[o], comp[o], n[o].astype(np.int64), odd[o], guest[o], block[o]
            first = int(odd.sum())
            if not first or len(sid) < 2 or (comp == comp[0]).all():
                continue
            signatures = rows["sig"].to_pylist()
            sig = _folded([signatures[i] for i in o], min(map(len, signatures)))

            def apart(i, j, comp=comp, guest=guest, block=block, mixed=mixed):
                ok = (i < j) & (comp[i] != comp[j]) & ~(guest[i] & guest[j])
                return ok & (block[i] != block[j]) if mixed else ok

            for i, j, spare in _near(sig, n, np.arange(first), np.arange(len(sid)), apart, num, den):
                more = np.zeros(len(i), np.int64)
                if links is not None:
                    best = np.lexsort((-spare, i))
                    i, j = i[best], j[best]
                    at = np.arange(len(i))
                    place = at - np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], at, 0))
                    more = np.isin(i, i[place == links]).astype(np.int64)
                    i, j, more = i[place < links], j[place < links], more[place < links]
                found.append((np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]), more))
                size += len(i)
                if size > 500_000:
                    yield out()
                    found, size = [], 0
        if found:
            yield out()

    return run


def _arrays(k: int):
    """(sid, n, sig, tokens, places) of texts whose set is the wanted one, once for each task."""
    names = ["sid", "n", "sig", "tokens", "places"]

    def made(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*rows, strict=True)), batch.column("places").take(pa.array(at))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            want = batch.column("want").to_numpy(zero_copy_only=False)
            at, rows = [], []
            for i, tokens in _sets(batch, k):
                if len(tokens) and want[i] not in seen and _sid(tokens) == want[i]:
                    seen.add(want[i])
                    at.append(i)
                    rows.append((int(want[i]), len(tokens), _signature(tokens), tokens.tobytes()))
                if len(rows) >= 512:
                    yield made(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield made(batch, at, rows)

    return run


def _does(num: int, den: int):
    def run(batches):
        for batch in batches:
            ok = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    # few sets are still in doubt: where their ids are small they are sent to the arrays, not the arrays to them
    doubted = write_table(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "doubted-sets")
    body = write_table(arrays.join(doubted, "sid", "left_semi").select("sid", "tokens"), "doubted-arrays", "none")
    met = pairs.join(body.toDF("a", "x"), "a").join(body.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return met.mapInArrow(_does(num, den), "a long, b long")


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of known components and further links: only components are linked anew."""
    links = write_table(links, "near-pairs")
    if links.isEmpty():
        return known
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    over = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    over = over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    new = connected_components(over).select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = known.unionByName(over.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return write_table(nodes.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "near-components")


def _candidates(tokens_of: DataFrame, sets: DataFrame, known: DataFrame, num: int, den: int, links: int | None) -> DataFrame:
    """(a, b, more): sets of different components that meet in a tile and may be similar.

    tokens_of: (lead, sid); sets: (sid, n, sig).
    """
    width = math.log(den / num) * 1.001  # a shade wider, so that no rounding parts similar sets by two bands
    size = sets.select("sid", F.floor(F.log("n") / width).cast("int").alias("band"), F.octet_length("sig").alias("w"))
    row = tokens_of.join(size, "sid").join(known.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    stay = F.struct(F.col("band").alias("tile"), F.lit(False).alias("guest"))
    visit = F.struct((F.col("band") + 1).alias("tile"), F.lit(True).alias("guest"))
    both = row.select("lead", "sid", "comp", "w", F.inline(F.array(stay, visit)))
    per = both.groupBy("lead", "tile", "comp").agg(F.count("*").alias("c"), F.sum("w").alias("w"), F.count_if(~F.col("guest")).alias("own"))
    tile = per.groupBy("lead", "tile").agg(F.sum("c").alias("rows"), F.sum("w").alias("w"), F.max(F.struct("c", "comp")).alias("top"), F.sum("own").alias("own"))
    mean = F.col("w") / F.col("rows")
    blocks = lambda rows: F.greatest(F.lit(1), F.ceil(rows / TILE), F.ceil(rows * mean / TILE_BYTES)).cast("int")
    tile = tile.filter((F.col("own") > 0) & (F.col("rows") > F.col("top.c"))).select(
        "lead", "tile", F.col("top.comp").alias("most"), blocks(F.col("rows") - F.col("top.c")).alias("gx"), blocks(F.col("top.c")).alias("gy")
    )
    met = both.drop("w").join(tile, ["lead", "tile"]).withColumn("odd", F.col("comp") != F.col("most"))
    met = met.withColumn("block", F.pmod(F.xxhash64("sid"), F.when(F.col("odd"), F.col("gx")).otherwise(F.col("gy"))).cast("int"))
    to = lambda g: F.sequence(F.lit(0), F.col(g) - 1)
    # cells: 0 for a tile of one block of each kind; odd ones for two odd blocks, even ones for an odd and an even block
    two = lambda a, b, g: (F.least(a, b) * F.col(g) + F.greatest(a, b)) * 2 + 1
    with_odd = F.transform(to("gx"), lambda w: F.struct(two(F.col("block"), w, "gx").cast("long").alias("cell"), (F.col("block") != w).alias("mixed")))
    with_even = F.transform(to("gy"), lambda w: F.struct(((F.col("block") * F.col("gy") + w) * 2).cast("long").alias("cell"), F.lit(False).alias("mixed")))
    of_even = F.transform(to("gx"), lambda w: F.struct(((w * F.col("gy") + F.col("block")) * 2).cast("long").alias("cell"), F.lit(False).alias("mixed")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(False).alias("mixed")))
    small = (F.col("gx") == 1) & (F.col("gy") == 1)
    cells = F.when(small, alone).when(~F.col("odd"), of_even).otherwise(F.concat(with_odd, with_even))
    # in a cell of an odd and an even block, two odd rows have met elsewhere: their block is one
    met = met.select("lead", "tile", "sid", "comp", "odd", "guest", "block", small.alias("small"), F.inline(cells))
    met = met.withColumn("mixed", F.col("mixed") | (~F.col("small") & (F.col("cell") % 2 == 0)))
    met = met.withColumn("block", F.when(F.col("cell") % 2 == 0, F.when(F.col("odd"), F.lit(-1)).otherwise(F.col("block"))).otherwise(F.col("block")))
    met = met.join(sets.select("sid", "n", "sig"), "sid").select("lead", "tile", "cell", "sid", "comp", "n", "odd", "guest", "block", "mixed", "sig")
    dealt = met.repartition("lead", "tile", "cell").sortWithinPartitions("lead", "tile", "cell")
    return dealt.mapInArrow(_cell_pairs(num, den, links), "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def join_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, root, component_id): one row per row of docs.

    h: the text's digest, by which rows that share a doc_id differ. root: one of the
    component's set ids, null without shingles.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = keyed.withColumn("h", digest(F.coalesce("text", F.lit(""))))
    features = write_table(hashed.mapInArrow(_features(k), "kind int, doc_id long, h binary, sid long, n long"), "shingle-sets")
    of_doc = features.filter("kind = 0").select("doc_id", "h", "sid", "n")
    frequent = features.filter("kind = 1").groupBy(F.col("sid").alias("token")).agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "token").limit(FREQUENT)
    late = np.array([r["token"] for r in frequent.collect()], np.int64).view(np.uint64)
    order = spark.sparkContext.broadcast(np.sort(late))

    prefix = keyed.mapInArrow(_prefixes(k, num, den, order), "token long, sid long, n int")
    dealt = prefix.repartition("token").sortWithinPartitions("token", "n", "sid")
    live = write_table(dealt.mapInArrow(_live(num, den), "token long, sid long, n int"), "live-prefixes")

    # a partner may be as small as ceil(n * num / den), and must share so much of that
    small = lambda n: F.ceil(n * num / F.lit(den))
    need = lambda n: F.least(F.greatest(F.lit(SHARED), F.floor(small(n) / SHARED_PART)) + 1, small(small(n)))
    nodes = live.groupBy("sid").agg(F.count("*").alias("c"), F.first("n").alias("m"))
    nodes = write_table(nodes.filter(F.col("c") >= need(F.col("m"))).select("sid", (F.col("c") / F.col("m")).alias("share")), "live-sets")
    # the set with the largest share of live tokens leads each token; a lead gives its tokens
    # to the one that leads most of its own, so that a group has few
    lead = live.join(nodes.hint("merge"), "sid").groupBy("token").agg(F.max(F.struct("share", "sid")).alias("l"), F.count("*").alias("c"))
    lead = lead.filter("c > 1").select("token", F.col("l.sid").alias("lead"))
    led = write_table(live.join(nodes.select("sid").hint("merge"), "sid").join(lead.hint("merge"), "token").groupBy("lead", "sid").agg(F.count("*").alias("c"), F.first("n").alias("n")), "led-sets")
    # with sets gone, others have too few tokens in common with those that stay
    nodes = write_table(led.groupBy("sid").agg(F.sum("c").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= need(F.col("n"))).select("sid"), "live-sets")
    led = led.join(nodes, "sid")
    first = lambda rows: rows.groupBy("sid").agg(F.max(F.struct("c", "lead")).alias("l"), F.first("n").alias("n")).select("sid", F.col("l.lead").alias("lead"), "n")
    above = first(led).select(F.col("sid").alias("lead"), F.col("lead").alias("above"))
    tokens_of = led.join(above, "lead").groupBy(F.col("above").alias("lead"), "sid").agg(F.sum("c").alias("c"), F.first("n").alias("n"))
    tokens_of = write_table(tokens_of, "led-sets")

    # each set goes to a chunk of the lead it shares most with, and leads to all their chunks
    own = first(tokens_of)
    sizes = own.groupBy("lead").agg(F.max(F.col("sid") != F.col("lead")).alias("many"), F.ceil(F.sum("n") / CHUNK_TOKENS).cast("int").alias("g")).filter("many")
    placed = own.join(sizes, "lead").select("lead", "sid", F.pmod(F.xxhash64("sid"), F.col("g")).cast("int").alias("chunk"))
    heads = sizes.select("lead", F.col("lead").alias("sid"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("chunk"))
    places = placed.union(heads).groupBy("sid").agg(F.collect_set(F.struct("lead", "chunk")).alias("places"))

    chosen = of_doc.filter("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("one")).join(nodes, "sid").join(places, "sid", "left")
    chosen = write_table(chosen.select(F.col("sid").alias("want"), F.col("one.doc_id").alias("rep"), F.col("one.h").alias("g"), "places"), "chosen-texts")
    # repeated rows meet the same choice and count once
    # all that follows grows with the corpus, so these joins are sort-merge joins at every size
    texts = hashed.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("g"))).select("want", "text", "places")
    arrays = write_table(texts.mapInArrow(_arrays(k), "sid long, n long, sig binary, tokens binary, places array<struct<lead:long,chunk:int>>"), "shingle-arrays", "none")
    dealt = arrays.select(F.inline("places"), "sid", "sig", "tokens").repartition("lead", "chunk").sortWithinPartitions("lead", "chunk")
    known = connected_components(write_table(dealt.mapInArrow(_chunk_links(num, den), "a long, b long"), "near-pairs"))

    sets = arrays.select("sid", "n", "sig")
    for links in (LINKS, None):
        pairs = write_table(_candidates(tokens_of.select("lead", "sid"), sets, known, num, den, links), "candidate-pairs")
        known = _merged(known, _verified(pairs.select("a", "b"), arrays, num, den))
        if pairs.filter("more").isEmpty():  # the first pass has judged all there is
            break

    member = of_doc.join(known.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("component", "sid"))
    member = write_table(member.select("doc_id", "h", "n", "sid", "root"), "near-members")
    # written, so that both sides of the join are plain exchanges, which adaptive execution splits for a hot component
    least = write_table(member.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-least")
    return member.join(least, "root", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id.

    Of texts that share that doc_id the one of the smallest digest stays; rows with equal
    doc_id and text are one document and all stay, as do rows without shingles, which have
    no near copies. A component without any doc_id keeps one text likewise.
    """
    found = join_components(docs, k, num, den, doc_id, text).filter("root IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    best = write_table(found.groupBy("root").agg(F.min(order).alias("w")), "near-best")  # written for the same reason
    same = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("h") == F.col("w.h"))
    lost = found.join(best, "root").filter(~same).select(F.col("doc_id").alias("_gone"), F.col("h").alias("_text")).distinct()
    # a row is lost if its own text is, whatever else bears its doc_id
    return docs.join(lost, F.col(doc_id).eqNullSafe(F.col("_gone")) & (digest(F.coalesce(F.col(text), F.lit(""))) == F.col("_text")), "left_anti")
