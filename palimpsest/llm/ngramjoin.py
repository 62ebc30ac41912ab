"""Set-similarity join of documents on word shingles by parity sketches.

A document's tokens are its distinct shingles, hashed to 64 bits. In its size band a document's sketch is P cells; a
token belongs to one cell, and a cell is the exclusive or of its tokens' hashes. Tokens that two documents share
cancel, so a cell differs only if a token of the symmetric difference lies in it: the number of unequal cells is a
lower bound of that difference, which the threshold limits to (1 - t) / (1 + t) of both sizes. By pigeonhole, two
similar documents then agree in all but so many cells, and the cells' values are join keys. A second sketch, of BITS
bits or, in larger sets, of one to two bits a token (up to MOST_BITS), in which each token flips one bit, gives the same
bound in bits and rejects most candidates before the sets themselves are compared. A wide one folds to a narrower one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ARROW_ROWS, SMALL, Stage, Staging, connected_components, distributed_rank, partitions, trim
from palimpsest.llm.grouped import Wire, in_blocks, large_keys, per_group, per_groups

BITS = 1024
MOST_BITS = 1 << 15
LEAST_CELLS = 64
SINGLE = 32
ROUNDS = 3  # of joining nearest components, before a dense key is compared within its task
_rng = np.random.default_rng(20)
BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 .. n-1, and their inverses modulo 2^64."""
    if len(_powers[0]) < n:
        m = 1 << n.bit_length()
        for i, b in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z in lower case, words parted by ASCII white space.

    A text with fewer words is one shingle; one without words has none.
    """
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    line = np.frombuffer(b" ".join(parts), np.uint8)
    up, down = _powers_to(len(line) + 1)
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(BYTE[line] * up[: len(line)], out=sums[1:])
    gaps = np.flatnonzero(line == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    k = min(words, len(parts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))


def bands(n: int) -> list[tuple[int, int]]:
    """(band, cells) in which a set of n tokens is entered. Bands are [2^b, 2^(b+1)); a set that can be similar to one
    of the next band is entered there too. A band's cells exceed the largest difference it allows; 0 stands for a cell
    a token, in bands of sets up to SINGLE tokens."""
    b = n.bit_length() - 1
    out = [b] + [b + 1] * (4 * n >= 3 * (1 << (b + 1)))
    return [(x, 0) if (2 << x) <= SINGLE else (x, max(LEAST_CELLS, (2 << (x + 1)) // 7 + 1)) for x in out]


def cell_keys(h: np.ndarray, most: int = 40, rest: bool = False) -> np.ndarray:
    """A set's join keys: the values of its cells that are not empty, in each of its bands; the first `most`, or the rest.

    In bands of sets up to SINGLE tokens each token is a key, so that similar sets always share one. In larger bands a
    band's cells outnumber the tokens by which similar sets can differ, so that some agree; agreeing ones are all empty
    with a chance below 1e-10 (at least a third of all cells agree and hold tokens, as a rule).
    """
    keys = []
    if not len(h):
        return np.empty(0, np.int64)
    for band, cells in bands(len(h)):
        tag = np.array([band << 40], np.uint64)
        if not cells:
            if not rest:
                keys.append(_mix(_mix(h) + _mix(tag + np.uint64(1))))
            continue
        cell = ((h >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        # tokens are hashed and sorted, so cells come in order, and the first ones are as good as any
        at = np.flatnonzero(np.diff(cell, prepend=cells))
        values, cell = np.bitwise_xor.reduceat(_mix(h), at), cell[at]
        chosen = (cell < most) != rest
        cell, values = cell[chosen], values[chosen]
        keys.append(_mix(values + _mix(cell + tag)))
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def _short(keys: np.ndarray) -> bytes:
    """The upper six bytes of each key: enough to propose pairs by, since equal keys prove nothing."""
    return keys.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def sketch_bits(n: int) -> int:
    """Bits of the sketch of n tokens: a power of two. Unrelated sets fill a sketch that is much smaller than they are, and the bound then rejects nothing."""
    return min(max(BITS, 1 << n.bit_length()), MOST_BITS)


def bit_sketch(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


class Sketches:
    """Bit sketches of several widths, and their distances: a pair is compared at the width of its narrower one, to which the other folds."""

    def __init__(self, data: list[bytes]):
        self.data, self.width = data, np.array([len(x) for x in data], np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each sketch of at least that width (in bytes) its row, and the rows."""
        if width not in self.at:
            place, parts, n = np.zeros(len(self.data), np.int64), [], 0
            for w in np.unique(self.width[self.width >= width]):
                these = np.flatnonzero(self.width == w)
                words = np.frombuffer(b"".join([self.data[i] for i in these]), np.uint64).reshape(len(these), w // width, width // 8)
                parts.append(np.bitwise_xor.reduce(words, axis=1))
                place[these] = np.arange(n, n + len(these))
                n += len(these)
            self.at[width] = place, np.concatenate(parts)
        return self.at[width]

    def distance(self, a: np.ndarray, b: np.ndarray, most: int = 1 << 25) -> np.ndarray:
        """Unequal bits of each pair; a chunk of pairs holds `most` bytes."""
        width = np.minimum(self.width[a], self.width[b])
        d = np.empty(len(a), np.int64)
        for w in np.unique(width):
            place, rows = self._folded(int(w))
            these = np.flatnonzero(width == w)
            step = max(1, most // int(w))
            for s in range(0, len(these), step):
                i = these[s : s + step]
                d[i] = np.bitwise_count(rows[place[a[i]]] ^ rows[place[b[i]]]).sum(1, dtype=np.int64)
        return d


def sketches(texts: DataFrame, most: int) -> DataFrame:
    """node, doc_id, v, n, d1, d2 (fingerprint of the whole set), bits, keys for (node, doc_id, v, text); and the other keys, packed, with their number m."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 500):
                out = []
                for t in b.column(3).slice(s, 500).to_pylist():
                    h = shingle_hashes(t)
                    m = _mix(h + np.uint64(1))
                    out.append((len(h), int(np.bitwise_xor.reduce(m, initial=np.uint64(0)).view(np.int64)), int(m.sum(dtype=np.uint64).view(np.int64)), bit_sketch(h, sketch_bits(len(h))).tobytes(), cell_keys(h, most), _short(cell_keys(h, most, True))))
                n, d1, d2, bits, keys, more = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).slice(s, 500) for i in range(3)], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(more, pa.binary()), pa.array([len(x) // 6 for x in more], pa.int64())],
                    names=["node", "doc_id", "v", "n", "d1", "d2", "bits", "keys", "more", "m"],
                )

    return texts.mapInArrow(run, "node long, doc_id long, v long, n long, d1 long, d2 long, bits binary, keys array<long>, more binary, m long")


def set_table(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, h): the shingle sets of the listed nodes (rep); the other texts stay out."""

    def sets(batches):
        for b in batches:
            for s in range(0, b.num_rows, 500):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, 500), pa.array([shingle_hashes(t).tobytes() for t in b.column(1).slice(s, 500).to_pylist()], pa.binary())], names=["rep", "h"])
        trim()

    return texts.select(F.col("node").alias("rep"), "text").join(ids, "rep", "left_semi").mapInArrow(sets, "rep long, h binary").dropDuplicates(["rep"])


def verified(stage: Staging, pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar, by comparing the sets."""

    def compare(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        trim()

    with Staging() as inner:
        have = inner(set_table(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), texts))
        left, right = (have.select(F.col("rep").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
        return stage(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(compare, "a long, b long"), {ARROW_ROWS: "1000"})


def similar_documents(docs: DataFrame, percent: int = 75, block: int = 4096, most: int = 40, range_most: int = 2_000_000, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id; and text_hash, keeper.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct five-word shingles;
    component_id is the smallest doc_id reachable by links. Sets are compared by 64-bit hashes of their shingles.
    Documents of equal sets are collapsed first. In round one each document is compared with the one document with
    which it shares most keys among the smallest ids of its keys. Later rounds look at every key that still holds several
    components: pairs from different ones whose bit sketches allow a link are compared, all of them if they are few, else
    each document with its nearest one; a key that had many comes again with the components known then. What is still dense
    after ROUNDS rounds is compared, sets against sets, within the key's task, and only connecting links leave it. Keys
    with more than `block` documents, and dense ones with sets of more than block_bytes, are dealt into pairs of blocks. So every pair with a common key is connected or
    compared, and no step emits more than a few rows for each document of a key. All this is done twice: with the first
    `most` cells of each band as keys, which connect nearly all that links, and then with all other cells that the
    pigeonhole bound asks for. The latter are packed; only those that hold several components by then become rows,
    and ranges of more than range_most of them are judged by joins that can be split.
    Null or empty texts, and texts without words, have no shingle and their own component. Null ids have a null component.
    Rows of one doc_id may hold different texts: each row is judged by its own, and the id alone links nothing.
    text_hash (xxhash64 of the text) tells them apart; keeper marks the rows of each component's first (doc_id,
    text_hash), all rows without shingles, and those without an id. An empty table gives no row.
    """
    if percent < 75:
        raise ValueError("the bands are laid out for 75 percent and more")
    with Staging() as stage:
        texts, ranked = nodes(stage, docs, id_col, text_col)
        base = stage(sketches(texts, most))
        real = base.where("n > 0 and doc_id is not null")
        classes = real.groupBy("n", "d1", "d2").agg(F.min("node").alias("rep"))
        with Staging() as first:
            whole = first(real.groupBy("n", "d1", "d2").agg(F.min("node").alias("rep"), F.min_by(F.struct("bits", "keys"), "node").alias("s")).select("rep", "n", "s.*"))
            light = whole.select("rep", F.explode("keys").alias("key"))
            shared = first(light.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead"))
            keyed = first(light.join(shared, "key"))
            sized = stage(whole.select("rep", "n", "bits"))
            known = first.keep(star_links(keyed, sized, texts, percent))
            comp = settle_keys(keyed.select("key", "rep"), known, sized, texts, percent, block, block_bytes)
        comp = stage.keep(comp)
        with Staging() as second:
            left = mixed_keys(second, base.select(F.col("node").alias("rep"), "more", "m"), sized.select("rep").join(comp, "rep", "left"), range_most)
            comp = settle_keys(left, comp, sized, texts, percent, block, block_bytes)
        comp = stage.keep(comp)
        member = classes.join(comp, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("c"))
        found = real.select("node", "doc_id", "v", "n", "d1", "d2").join(member, ["n", "d1", "d2"]).select("doc_id", "v", "n", "c", (F.col("node") == F.col("c")).alias("keeper"))
        if ranked is not None:
            found = found.join(ranked.select(F.col("node").alias("c"), F.col("doc_id").alias("_c")), "c").select("doc_id", "v", "n", F.col("_c").alias("c"), "keeper")
        rest = base.where("n = 0 or doc_id is null").select("doc_id", "v", "n", F.col("doc_id").alias("c"), F.lit(True).alias("keeper"))
        out = Stage(found.union(rest))
    return out.df().select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("v").alias("text_hash"), "keeper")


def nodes(stage: Staging, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(node, doc_id, v, text), and what doc_id a node has if that is not the node itself.

    A node is a doc_id with one text. Where ids come with several texts, nodes are ranks in order of (doc_id, v)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("text"))
    several = texts.where("doc_id is not null").groupBy("doc_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi")
    if several.isEmpty():
        return texts.select(F.col("doc_id").alias("node"), "doc_id", "v", "text"), None
    known = stage(distributed_rank(texts.where("doc_id is not null").select("doc_id", "v").distinct(), F.lit(0), [F.col("doc_id"), F.col("v")], "node"))
    return stage(texts.join(known, ["doc_id", "v"], "left").select("node", "doc_id", "v", "text")), known


def star_links(keyed: DataFrame, sized: DataFrame, texts: DataFrame, percent: int) -> Stage:
    """(rep, component) of the links between each document and the least one of most of its keys, from (key, lead, rep)."""
    votes = keyed.where("rep > lead").groupBy("rep", "lead").agg(F.count("*").alias("votes"))
    best = votes.groupBy("rep").agg(F.max(F.struct("votes", -F.col("lead"))).alias("v")).select((-F.col("v")["col2"]).alias("a"), F.col("rep").alias("b"))
    star = best.join(sized.selectExpr("rep a", "n na", "bits ba"), "a").join(sized.selectExpr("rep b", "n nb", "bits bb"), "b")
    with Staging() as stage:
        star = stage(star.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_possible(percent), "a long, b long"))
        links = verified(stage, star, texts, percent)
        return Stage(connected_components(links, stage).select(F.col("node").alias("rep"), "component"))


def settle_keys(left: DataFrame, known: DataFrame, sized: DataFrame, texts: DataFrame, percent: int, block: int, block_bytes: int) -> Stage:
    """(rep, component) with the links between documents that share a key (key, rep) added to those known; see similar_documents."""
    with Staging() as stage:
        last = False
        for step in range(ROUNDS + 1):
            last = last or step == ROUNDS
            comp = stage(left.join(known, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")))
            mixed = stage(comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
            members = stage(comp.join(mixed, "key", "left_semi"))
            held = in_blocks(members.join(sized, "rep"), "key", large_keys(members, "key", block), block)
            asked = stage(per_groups(held, "key", ["rep", "comp", "n", "bits"], _cross(percent), "key long, _i int, _j int, _side int, rep long, comp long, other long, dense boolean"))
            pair = [F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")]
            dense = stage(asked.where("dense").select("key").distinct())
            if not last:
                found = verified(stage, stage(asked.select(*pair).distinct()), texts, percent)
            else:
                many = stage(asked.where("dense").select("key", "rep", "comp").distinct())
                sets = stage(set_table(many.select("rep").distinct(), texts))
                full = in_blocks(many, "key", heavy_keys(many.join(sized.select("rep", "n"), "rep"), block, block_bytes), block).join(sets, "rep")
                found = verified(stage, stage(asked.where("not dense").select(*pair).distinct()), texts, percent)
                found = found.union(stage(per_group(full, "key", ["rep", "comp", "h"], _link(percent), "a long, b long").distinct()))
            news = not found.isEmpty()
            if news:
                known = joined_components(stage, known, found)
            if last or dense.isEmpty():
                break
            last = not news  # the next round would ask for the same pairs
            left = members.select("key", "rep").join(dense, "key", "left_semi")
        return Stage(known)


def heavy_keys(rows: DataFrame, block: int, block_bytes: int) -> DataFrame | None:
    """(key, _n) of keys (key, n of each set) with more than `block` sets or block_bytes of them, or None: _n as if all
    blocks were full, so that in_blocks makes none that holds more, but for the spread of a hash. A key's sets are of one size band."""
    blocks = F.greatest(F.count("*") / block, F.sum(8 * F.col("n")) / block_bytes)
    heavy = Stage(rows.groupBy("key").agg(F.ceil(blocks * block).alias("_n")).where(F.col("_n") > block)).df()
    return None if heavy.isEmpty() else heavy


WIRE = Wire(np.uint32, np.int64, np.int64)  # key in its range, document, component


def _pack_keys(ranges: int, piece: int = 1 << 20):
    names = ["range", "n", "data"]

    def emit(parts: list[tuple]) -> pa.RecordBatch:
        key = np.concatenate([k for k, *_ in parts])
        sizes = [len(k) for k, *_ in parts]
        rep, comp = (np.repeat(np.array(x, np.int64), sizes) for x in list(zip(*parts))[1:])
        o = np.argsort(key)
        r, low = WIRE.place(key[o], ranges)
        r, n, data = WIRE.deal(r, (low, rep[o], comp[o]))
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(n), pa.array(data, pa.binary())], names=names)

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for rep, comp, more in zip(*(c.to_pylist() for c in b.columns)):
                parts.append((_long(more), rep, comp))
                size += len(more) // 6
                if size >= piece:
                    yield emit(parts)
                    parts, size = [], 0
        if size:
            yield emit(parts)
        trim()

    return run


def _unpack_keys(r: int, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, rep, comp = WIRE.unpack(data)
    return (np.int64(r) << 32) | key.astype(np.int64), rep, comp


def _judge_keys(batches):
    """Of each range: the rows of keys that hold several components."""

    def one(r: int, data: list[bytes]) -> list[pa.RecordBatch]:
        key, rep, comp = _unpack_keys(r, data)
        o = np.argsort(key, kind="stable")
        key, rep, comp = key[o], rep[o], comp[o]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        several = np.minimum.reduceat(comp, at) < np.maximum.reduceat(comp, at)
        take = np.repeat(several, np.diff(np.append(at, len(key))))
        return pa.table([pa.array(key[take]), pa.array(rep[take])], names=["key", "rep"]).to_batches(20_000)

    now, data = None, []
    for b in batches:
        for r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if r != now and data:
                yield from one(now, data)
                data = []
            now = r
            data.append(d)
    if data:
        yield from one(now, data)
    trim()


def _key_rows(batches):
    for b in batches:
        for r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield from pa.table(list(_unpack_keys(r, [d])), names=["key", "rep", "comp"]).to_batches(20_000)


def key_ranges(keys: int, each: int = 250_000, most: int = 1 << 14) -> int:
    """Ranges to deal that many packed keys into, some `each` keys a range, whatever the number of tasks: a task makes one
    packed row a range for each million of its keys, so that `most` ranges still leave 64 keys a row. Only above
    2 * 10^10 keys do ranges outgrow what one task judges; joins judge them then."""
    return max(1, min(most, -(-keys // each)))


def mixed_keys(stage: Staging, packed: DataFrame, comp: DataFrame, most: int) -> DataFrame:
    """(key, rep) of the packed keys (rep, more, and their number m) that several components (rep, component; null: its own) share."""
    n = partitions(packed.sparkSession)
    ranges = key_ranges(packed.agg(F.sum("m")).first()[0] or 0)
    held = packed.where("m > 0").join(comp, "rep").select("rep", F.coalesce("component", "rep").alias("comp"), "more")
    with Staging() as inner:
        dealt = inner(held.mapInArrow(_pack_keys(ranges), "range int, n long, data binary"), {ARROW_ROWS: "2000"}, **{"parquet.block.size": 8 << 20})
        hot = [r[0] for r in dealt.groupBy("range").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()]  # of 16,384 ranges at most
        rows = dealt.select("range", "data")
        out = stage(rows.where(~F.col("range").isin(hot)).repartition(n, "range").sortWithinPartitions("range").mapInArrow(_judge_keys, "key long, rep long"), SMALL)
        if hot:
            each = inner(rows.where(F.col("range").isin(hot)).mapInArrow(_key_rows, "key long, rep long, comp long"))
            several = inner(each.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
            out = out.union(stage(each.join(several, "key", "left_semi").select("key", "rep")))
    return out


def joined_components(stage: Staging, known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (rep, component) when links (a, b) are added: only the new links between components are worked through."""
    known = known.withColumnRenamed("rep", "node")
    of = known.select(F.col("node").alias("n"), F.col("component").alias("c"))
    ends = links.join(of.withColumnsRenamed({"n": "a", "c": "ca"}), "a", "left").join(of.withColumnsRenamed({"n": "b", "c": "cb"}), "b", "left")
    moved = stage(connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), stage))
    old = known.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stage(old.union(moved.join(known.select("node"), "node", "left_anti")).withColumnRenamed("node", "rep"))


def _bound(na, nb, percent: int):
    """100 times the largest symmetric difference of similar sets of these sizes, as (100 + p) * D <= (100 - p) * (a + b)."""
    return (100 - percent) * (na + nb)


def _possible(percent: int):
    def run(batches):
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            one = np.arange(b.num_rows)
            d = Sketches(b.column(4).to_pylist() + b.column(5).to_pylist()).distance(one, one + b.num_rows)
            ok = ((100 + percent) * d <= _bound(na, nb, percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    return run


def _pairs(group: np.ndarray, large: int = 64, most: int = 1 << 18):
    """(a, b), a < b, of all pairs of rows of one group, in chunks; group: ascending numbers."""
    size = np.bincount(group)
    begin = np.cumsum(size) - size
    rows = np.flatnonzero(size[group] <= large)
    left = (begin + size)[group[rows]] - rows - 1  # rows after it in its group
    for step in range(1, large):
        rows, left = rows[left >= step], left[left >= step]
        if not len(rows):
            break
        for s in range(0, len(rows), most):
            yield rows[s : s + most], rows[s : s + most] + step
    for g in np.flatnonzero(size > large):
        m, at = int(size[g]), int(begin[g])
        block = max(1, most // m)
        for s in range(0, m, block):
            a, b = np.nonzero(np.arange(s, min(m, s + block))[:, None] < np.arange(m))
            yield a + s + at, b + at


def _cross(percent: int, few: int = 4):
    """Pairs of a key's documents from different components whose sketches allow a link (rep, other).

    If they are few for the number of documents, all of them; else the key is dense, and each document has its nearest
    one by sketch, if there is any. The documents of a dense key that can link at all are all named.
    """
    names = ["key", "_i", "_j", "_side", "rep", "comp"]

    def work(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        rep, comp, n, side, i, j = (t.column(c).to_numpy() for c in ("rep", "comp", "n", "_side", "_i", "_j"))
        bits = Sketches(t.column("bits").to_pylist())
        nothing = np.iinfo(np.int64).max
        best = np.full(len(comp), nothing)  # of each document: least distance and then the other's number
        count, room = np.zeros(group[-1] + 1, np.int64), few * np.bincount(group)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _pairs(group):
            fits = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((i[a] == j[a]) | (side[a] != side[b]))
            a, b = a[fits], b[fits]
            d = bits.distance(a, b)
            ok = (100 + percent) * d <= _bound(n[a], n[b], percent)
            a, b, d = a[ok], b[ok], d[ok]
            np.minimum.at(best, a, (d << 32) | b)
            np.minimum.at(best, b, (d << 32) | a)
            count += np.bincount(group[a], minlength=len(count))
            sparse = (count <= room)[group[a]]
            kept.append((a[sparse], b[sparse]))
        dense = count > room
        near = np.flatnonzero((best < nothing) & dense[group])
        a, b = (np.concatenate(x) for x in zip(*kept)) if kept else (np.empty(0, np.int64),) * 2
        sparse = ~dense[group[a]]
        at, other = np.concatenate([near, a[sparse]]), np.concatenate([best[near] & 0xFFFFFFFF, b[sparse]])
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays([*[pa.array(t.column(c).to_numpy()[at]) for c in names], pa.array(rep[other]), pa.array(dense[group[at]])], names=[*names, "other", "dense"])

    return work


def _link(percent: int):
    """Links that connect a key's components: one document's set is marked and counted in all others at once."""

    def work(g: pa.Table) -> pa.RecordBatch | None:
        rep, comp, side = (g.column(c).to_numpy() for c in ("rep", "comp", "_side"))
        sets = [np.frombuffer(x, np.uint64) for x in g.column("h").to_pylist()]
        n = np.array([len(x) for x in sets])
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(n)])
        split, group = side.any(), np.unique(comp, return_inverse=True)[1]
        found = []
        marked = np.zeros(token.max() + 1, np.int64)
        for i in range(len(rep)):
            j = np.flatnonzero((group != group[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (side != side[i] if split else True))
            j = j[j > i]
            if not len(j):
                continue
            own = token[begin[i] : begin[i + 1]]
            marked[own] = 1
            at = np.concatenate([[0], np.cumsum(n[j])])
            inside = np.repeat(begin[j] - at[:-1], n[j]) + np.arange(at[-1])
            common = np.add.reduceat(marked[token[inside]], at[:-1])
            marked[own] = 0
            for k in j[100 * common >= percent * (n[i] + n[j] - common)]:
                if group[k] != group[i]:
                    found.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                    group[group == group[k]] = group[i]
        if not found:
            return None
        a, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work
