"""Line deduplication by aligning pairs of documents that share rare lines."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ARROW_ROWS, Stage, Staging, packed, trim, unpacked

BLANK = " \t\x0b\f\r\xa0"


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, length) of a patience diff of two sequences.

    Equal ends are matched first; then elements that occur once in both parts are matched along their longest
    increasing subsequence, and the stretches between the matches are worked through likewise.
    """
    match: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            match.append((a0, b0))
            a0 += 1
            b0 += 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1 -= 1
            b1 -= 1
            match.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a: dict[int, int] = {}
        once_b: dict[int, int] = {}
        for at, seq, lo, hi in ((once_a, a, a0, a1), (once_b, b, b0, b1)):
            for i in range(lo, hi):
                at[seq[i]] = -1 if seq[i] in at else i
        pairs = [(i, once_b[x]) for x, i in once_a.items() if i >= 0 and once_b.get(x, -1) >= 0]
        if not pairs:  # nothing to anchor on; see Earlier.shared_lines
            continue
        tops: list[int] = []
        piles: list[int] = []
        back = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(tops, j)
            back[k] = piles[p - 1] if p else -1
            tops[p : p + 1] = [j]
            piles[p : p + 1] = [k]
        chain = []
        k = piles[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        ends = [(a0 - 1, b0 - 1), *reversed(chain), (a1, b1)]
        match += ends[1:-1]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(match):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def runs(w: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest runs (start, end) of at least min_words words from each line on and up to each line, w being words a line.

    Every longer run is covered by those inside it, and which they are depends on its own lines only, so two documents
    share a run of min_words words only if they share these. All of a document that is too short is one run.
    """
    out: dict[tuple[int, int], None] = {}
    s = total = 0
    for e, n in enumerate(w, 1):
        total += n
        while total >= min_words:
            last = total - w[s] < min_words
            if last or total - n < min_words:
                out[s, e] = None
            if last:
                break
            total -= w[s]
            s += 1
    return list(out) or ([(0, len(w))] if w else [])


class Earlier:
    """A document that owns runs of lines, indexed once for all later documents that are compared with it."""

    def __init__(self, lines: list[int]):
        self.lines, self.at = lines, {}
        for i, x in enumerate(lines):
            self.at.setdefault(x, []).append(i)

    def beside(self, b: list[int]) -> list[int]:
        """The document without the lines that b lacks; each gap is one mark that equals nothing."""
        kept = sorted(i for x in set(b) for i in self.at.get(x, ()))
        out: list = []
        for k, i in enumerate(kept):
            if not k or kept[k - 1] != i - 1:
                out.append((i,))
            out.append(self.lines[i])
        return out

    def shared_lines(self, b: list[int], w: list[int], min_words: int) -> list[int]:
        """The lines of b, w words each, that lie in a run of at least min_words words which this holds too, or all if equal.

        Patience diff finds most of them; what it leaves (repeated or moved passages) is searched run by run.
        """
        if self.lines == b:
            return list(range(len(b)))
        if sum(w) < min_words:
            return []
        a, gone = self.beside(b), set()
        for _, j, k in patience_blocks(a, b):
            if sum(w[j : j + k]) >= min_words:
                gone.update(range(j, j + k))
        if len(gone) == len(b):
            return sorted(gone)
        open_runs = [(s, e) for s, e in runs(w, min_words) if not gone.issuperset(range(s, e)) and all(x in self.at for x in b[s:e])]
        grams = {n: {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} for n in {e - s for s, e in open_runs}}
        for s, e in open_runs:
            if tuple(b[s:e]) in grams[e - s]:
                gone.update(range(s, e))
        return sorted(gone)


def dedup_lines(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, text without the blocks that align with an earlier document; and what went.

    Added columns: n_lines, n_removed (lines), removed_from (smallest doc_id whose blocks were deleted here, null if
    none). Of the same names in docs, they replace the columns.
    Lines are parted by line feeds and compared exactly; lines of white space alone are not compared. Documents meet
    through shared hashes of lines: of each shortest run of lines with at least min_words words (or all of a shorter
    document), since a run is the least that is deleted, and what is rare among single lines is in some rare run. A run
    belongs to the smallest doc_id with it; each later document with the run is paired with that one, so that a frequent
    run too gives one pair for each document, and every passage of min_words words that any earlier document holds is met.
    Each pair is aligned by patience diff over all its lines, and what that leaves is searched for common runs; every
    run of at least min_words words that the earlier document holds, at any place and however often, is deleted from the
    later one, and so is a run that is all of both documents. Blank lines between deleted lines go with them.
    Shorter blocks stay, by intent: a heading, a date or a licence line is equal in documents that have nothing else in
    common, and clean documents must keep it; min_words=1 deletes every aligned line.
    Remaining lines are joined by line feeds. Decisions rest on the texts as given, not on what other pairs have left.
    Null text stays null; null ids are passed on unchanged. Rows of one doc_id are versions of one document: each is
    compared by its own text with documents of smaller ids, and they take nothing from each other, so that equal rows
    lose the same lines. An empty table stays empty. The text is shuffled once, to meet its document's deletions; all
    else is hashes.
    """
    src = docs.drop(*[c for c in ("n_lines", "n_removed", "removed_from") if c in docs.columns])
    lines = F.split(F.col(text_col), "\n", -1)
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.size(F.split(F.trim(F.regexp_replace(x, "[\\s\\u00a0]+", " ")), " ")).alias("w"), (F.trim(F.regexp_replace(x, "[\\s\\u00a0]+", " ")) == "").alias("blank"))), lambda s: ~s["blank"])
    shape = src.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("v"), numbered.alias("l"))

    def keys(batches):
        for batch in batches:
            doc, version, key = [], [], []
            for d, v, h, w in zip(*(c.to_pylist() for c in batch.columns)):
                own = {hash(tuple(h[s:e])) for s, e in runs(w, min_words)}  # of integers, so the same in every process
                doc += [d] * len(own)
                version += [v] * len(own)
                key += own
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(version, pa.int64()), pa.array(key, pa.int64())], names=["doc", "v", "h"])
        trim()

    def align(batches):
        last, earlier = None, None
        for batch in batches:
            out = []
            a, va, lists, *rest = batch.columns  # in order of a: an owner of many pairs is read once
            for i, (a, va, b, vb, hb, w, pos) in enumerate(zip(a.to_pylist(), va.to_pylist(), *(c.to_pylist() for c in rest))):
                if (a, va) != last:
                    last, earlier = (a, va), Earlier(lists[i].as_py())
                gone = [pos[j] for j in earlier.shared_lines(hb, w, min_words)]
                if gone:
                    out.append((a, b, vb, gone))
            a, b, vb, gone = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (a, b, vb)], pa.array(gone, pa.list_(pa.int32()))], names=["a", "b", "vb", "gone"])
        trim()

    with Staging() as stage:
        shape = stage(shape.select("doc", "v", F.col("l.pos").alias("pos"), F.col("l.h").alias("h"), F.col("l.w").alias("w")).where(F.size("h") > 0).dropDuplicates(["doc", "v"]))
        # staged, so that both sides of each join are plain exchanges and a very common key's rows can be split
        seen = stage(shape.select("doc", "v", "h", "w").mapInArrow(keys, "doc long, v long, h long"), {ARROW_ROWS: "2000"})
        owner = stage(seen.groupBy("h").agg(F.min(F.struct("doc", "v")).alias("a"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h", F.col("a.doc").alias("a"), F.col("a.v").alias("va")))
        pairs = stage(seen.join(owner, "h").where("doc > a").select("a", "va", F.col("doc").alias("b"), F.col("v").alias("vb")).distinct())
        first = shape.select(F.col("doc").alias("a"), F.col("v").alias("va"), F.col("h").alias("ha"))
        later = shape.select(F.col("doc").alias("b"), F.col("v").alias("vb"), F.col("h").alias("hb"), "w", "pos")
        # the later documents' lists come first: they have few partners, and an owner's list is then never shuffled for each of its pairs
        cuts = pairs.join(later, ["b", "vb"]).join(first, ["a", "va"]).select("a", "va", "ha", "b", "vb", "hb", "w", "pos").mapInArrow(align, "a long, b long, vb long, gone array<int>")
        # a document has few partners (at most its lines), so its list is bounded by the document
        cuts = cuts.select("a", "b", "vb", F.explode("gone").alias("p")).groupBy("b", "vb").agg(F.min("a").alias("_from"), F.collect_set("p").alias("_gone"))
        cuts = Stage(cuts, {ARROW_ROWS: "500"}).df()  # rows of a pair hold two documents' lists
    part = packed(src, id_col, text_col)
    ids = part.withColumns({"_id": F.col(f"`{id_col}`").cast("long"), "_v": F.xxhash64(text_col)})
    # a merge join at every size: the deletions grow with the texts
    joined = ids.join(cuts.withColumnsRenamed({"b": "_id", "vb": "_v"}).hint("merge"), ["_id", "_v"], "left")
    schema = T.StructType([*part.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_from", T.LongType())])

    def cut(batches):
        for b in batches:
            texts, n, m = [], [], []
            for t, gone in zip(b.column(1).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                parts = [] if t is None else t.split("\n")
                n.append(len(parts))
                if gone:
                    keep = np.ones(len(parts), bool)
                    keep[gone] = False
                    gone = sorted(gone)
                    for i, j in zip(gone, gone[1:]):
                        if not any(p.strip(BLANK) for p in parts[i + 1 : j]):
                            keep[i + 1 : j] = False
                m.append(int((~keep).sum()) if gone else 0)
                if gone:
                    t = "\n".join([p for p, k in zip(parts, keep) if k])
                texts.append(t)
            cols = list(b.columns[:-2])
            cols[1] = pa.array(texts, cols[1].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(m, pa.int64()), b.column(b.num_columns - 2)], names=schema.names)

    done = joined.select(*part.columns, "_from", "_gone").mapInArrow(cut, schema)
    return done.select(*unpacked(src.columns, id_col, text_col), "n_lines", "n_removed", "removed_from")
