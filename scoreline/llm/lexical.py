"""Operator 13: ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Terms are maximal runs of digits, A-Z lower-cased, a-z and whatever lies beyond ASCII. A term's score
in a document is its weight w times its impact (1000000000 * tf) div (1000 * tf + 8 * m), where m grows
with the document's length against the average; an item sums them over its terms, repeats included.

- One pass over the texts counts each document's terms and those that items ask for; it is written,
  and N, L and df are added up from it. Texts are never moved.
- Documents stay where they are: each task indexes a block of its documents at a time, a list by
  impact for each term, and answers every item on it, carrying the item's best documents so far.
- Within a block the lists of an item are read side by side, best impacts first, some positions in
  each round. Each document met is looked up in all lists at once: its impacts give its whole score, its
  positions are marked as seen. A list's best position is the end of its seen positions from the
  start; the impacts there, weighed and summed, bound what any document not met can score. The search
  stops when that bound is strictly below the k-th best score, as equal scores are decided by id.
- Each task gives at most k documents an item; these are merged in two steps, by groups of tasks first.

Items are taken in runs of at most `TERMS` distinct terms (or one item that has more), in passes of
at most `PASS_TERMS`, so what is sent to tasks is bounded, and an item's terms come to the driver one run
at a time. A row of docs is a document: rows of a null or repeated id stand for themselves (a null id
comes first among equal scores). Rows of items with one id are one item with all their terms; a null
id is an id. Null or empty texts have no terms; items without terms or matches give no rows. Very long texts are
read in pieces of `PIECE` bytes, cut between terms. An empty table gives no rows. Further columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, id_text, raw_texts, slices, tidy, written

#: Distinct terms of a run of items, and of a pass over the texts.
TERMS, PASS_TERMS = 4096, 1 << 17
#: Cells (documents x terms) and most documents of a block.
CELLS, DOCS = 1 << 22, 1 << 13
#: Positions read in a list in the first round; doubled each round.
FIRST = 16
#: Bytes of text whose terms are listed together.
PIECE = 1 << 20
#: Percentage of the score's length normalisation; fixed.
SLOPE = 75

#: Letters lower-cased, digits and bytes beyond ASCII kept, all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "item_id long, doc_id long, score long"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 text, in lists of a bounded size."""
    at = 0
    while len(raw) - at > 2 * PIECE:
        # a piece ends behind a byte of no term, if there is one
        piece = raw[at : at + PIECE].translate(_FOLD)
        end = piece.rfind(b" ") + 1
        if not end:
            rest = raw[at:].translate(_FOLD)
            end = rest.find(b" ") + 1 or len(rest)
            piece = rest
        yield piece[:end].split()
        at += end
    yield raw[at:].translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Items:
    """A run of items: the numbers of their distinct terms, and each item's terms and their repeats."""

    def __init__(self, items: list[tuple[int | None, Counter]]):
        self.items = items
        self.terms = sorted(set().union(*(c for _, c in items)))

    def plans(self, number: dict[bytes, int], weights: dict[bytes, int]) -> list[tuple[int | None, np.ndarray, np.ndarray]]:
        """(item, its terms' places in self.terms, repeats x weight) with terms of no weight left out."""
        place = {t: i for i, t in enumerate(self.terms)}
        out = []
        for item, counts in self.items:
            kept = [(place[t], n * weights[t]) for t, n in counts.items() if weights.get(t)]
            if kept:
                rows, w = zip(*kept, strict=True)
                out.append((item, np.array(rows), np.array(w, np.int64)))
        return out


def item_runs(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """Items in order of id, in runs of at most TERMS distinct terms."""
    rows = id_text(items, id_col, text_col, "item_id", "text").where("text is not null").orderBy("item_id", "text")
    run: list[tuple[int | None, Counter]] = []
    seen: set[bytes] = set()
    for row in rows.toLocalIterator():
        counts = Counter()
        for part in terms_of(row.text.encode()):
            counts.update(part)
        if run and run[-1][0] == row.item_id:
            run[-1][1].update(counts)
            seen.update(counts)
            continue
        if run and len(seen.union(counts)) > TERMS:
            yield Items(run)
            run, seen = [], set()
        run.append((row.item_id, counts))
        seen.update(counts)
    if run:
        yield Items(run)


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of COUNTED for documents with terms: how many, and which of the vocabulary how often. Written."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most PASS_TERMS terms, or one item's

    @tidy
    def run(batches):
        number = shared.value
        get = number.get
        for batch in slices(batches, "text"):
            buf, starts, ends = raw_texts(batch.column("text"))
            total, sizes, terms, tfs = [], [], [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                n, seen = 0, Counter()
                for part in terms_of(buf[s:e].tobytes()):
                    n += len(part)
                    seen.update(map(get, part))
                seen.pop(None, None)
                total.append(n)
                sizes.append(len(seen))
                terms.extend(seen)
                tfs.extend(seen.values())
            cut = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"]
            )
            yield out.filter(pa.array(np.array(total) > 0))

    table = written(id_text(docs, id_col, text_col).mapInArrow(run, COUNTED))
    shared.destroy()
    return table


class Block:
    """Impact-ordered lists over some documents, for one run of terms.

    impact[t, d] is 0 where document d lacks term t; order[t] lists the documents by impact, and place[t, d] is
    d's position in it; documents without the term share the position behind the list's end.
    """

    def __init__(self, terms: int, docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        self.docs = docs
        self.length = np.bincount(term, minlength=terms)
        by = np.lexsort((doc, -impact, term))
        term, doc, impact = term[by], doc[by], impact[by]
        at = np.arange(len(term)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.impact = np.zeros((terms, docs), np.int32)
        self.impact[term, doc] = impact
        self.order = np.zeros((terms, docs), np.int32)
        self.order[term, at] = doc
        self.place = np.full((terms, docs), docs, np.int32)
        self.place[term, doc] = at
        #: Impacts by position; 0 behind the end.
        self.at = np.zeros((terms, docs + 1), np.int32)
        self.at[term, at] = impact

    def best(self, rows: np.ndarray, weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may be among the k best with a score of at least `least`."""
        alive = self.length[rows] > 0
        rows, weights = rows[alive], weights[alive]
        none = np.zeros(0, np.int64)
        if not len(rows):
            return none, none
        length = self.length[rows]
        met = np.zeros(self.docs, bool)
        # a position more, behind every list's end, takes the marks of documents that lack the term
        seen = np.zeros((len(rows), self.docs + 1), bool)
        best = np.zeros(len(rows), np.int64)
        line = np.arange(len(rows))[:, None]
        docs, scores, begin, step, kth = [], [], 0, FIRST, least
        while True:
            # what a document not met can have at most in each list: the impact at the best position
            bound = int((weights * self.at[rows, np.maximum(best - 1, 0)] * (best < length)).sum())
            if bound < kth or (best >= length).all():
                break
            end = begin + step
            window = self.order[rows, begin:end]
            fresh = window[np.arange(begin, begin + window.shape[1]) < length[:, None]]
            new = np.zeros(self.docs, bool)
            new[fresh] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            if len(new):
                # direct access: impacts and positions of the new documents in every list
                docs.append(new)
                scores.append(weights @ self.impact[rows[:, None], new].astype(np.int64))
                seen[line, self.place[rows[:, None], new]] = True
                seen[:, -1] = False
                if sum(map(len, docs)) >= k:
                    so_far = np.concatenate(scores)
                    kth = max(least, int(np.partition(so_far, len(so_far) - k)[len(so_far) - k]))
            best = np.minimum(np.argmin(seen, axis=1), length)
            begin, step = end, step * 2
        if not docs:
            return none, none
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = scores >= max(kth, 1)
        return docs[keep], scores[keep]


def _blocks(batches, width: int):
    """(ids, m's numerators n, owners, terms, tfs) of runs of documents that a block may hold."""
    most = max(16, min(DOCS, CELLS // width))
    held, rows = [], 0
    for batch in batches:
        for s in range(0, batch.num_rows, most):
            held.append(batch.slice(s, most))
            rows += held[-1].num_rows
            if rows >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _ranked(k: int, by: list[str]):
    return Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0."""
    out, pending, width = [], [], 0
    for run in item_runs(items, item_id, item_text):
        if pending and width + len(run.terms) > PASS_TERMS:
            out.append(_pass(docs, pending, k, id_col, text_col))
            pending, width = [], 0
        pending.append(run)
        width += len(run.terms)
    if pending:
        out.append(_pass(docs, pending, k, id_col, text_col))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _pass(docs: DataFrame, runs: list[Items], k: int, id_col: str, text_col: str) -> DataFrame:
    number = {t: i for i, t in enumerate(sorted(set().union(*(r.terms for r in runs))))}
    table = counted(docs, number, id_col, text_col)
    total = table.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()  # one row
    have = {r["term"]: r["df"] for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()}  # a row for each term of the pass
    n, length = total["n"], total["l"] or 1
    weights = {t: weight(n, have[i]) for t, i in number.items() if i in have}
    plans = [(np.array([number[t] for t in r.terms], np.int64), r.plans(number, weights)) for r in runs]
    shared = docs.sparkSession.sparkContext.broadcast(plans)  # bounded like the vocabulary

    @tidy
    def answer(batches):
        best: dict[int, list[tuple[int, int, int | None]]] = {}
        # one pass over the rows for all runs: blocks are cut for the widest
        width = max((len(t) for t, _ in shared.value), default=1)
        for rows in _blocks(batches, max(width, 1)):
            ids = rows.column("doc_id").to_pylist()
            size = rows.column("n").to_numpy().astype(np.int64)
            m = 100 - SLOPE + (SLOPE * size * n) // length
            lists = rows.column("terms").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy().astype(np.int64)
            tfs = rows.column("tfs").combine_chunks()
            tf = (tfs.chunk(0) if isinstance(tfs, pa.ChunkedArray) else tfs).flatten().to_numpy().astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
            for r, (terms, items) in enumerate(shared.value):
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                mine = terms[at] == term
                block = Block(len(terms), len(ids), at[mine], owner[mine], impact[mine])
                for i, (_, places, w) in enumerate(items):
                    top = best.setdefault((r, i), [])
                    found, scores = block.best(places, w, -top[-1][0] if len(top) == k else 0, k)
                    if len(found):
                        top.extend((-s, -1 if ids[d] is None else 0, ids[d]) for d, s in zip(found.tolist(), scores.tolist(), strict=True))
                        top.sort(key=lambda x: (x[0], x[1], x[2] or 0))
                        del top[k:]
        rows = [(shared.value[r][1][i][0], d, -s) for (r, i), top in best.items() for s, _, d in top]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    parts = table.mapInArrow(answer, FOUND)
    # of each group of tasks, then of all, the k best
    parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(_ranked(k, ["item_id", "part"]))).where(F.col("rank") <= k).drop("rank", "part")
    best = written(parts.withColumn("rank", F.row_number().over(_ranked(k, ["item_id"]))).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    dropped(table)
    shared.destroy()
    return best
