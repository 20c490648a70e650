"""Filling containers of one fixed capacity with whole texts (problem 8).

Method: swap-based local search. Texts are dealt by hash into bounded groups;
each group is filled first-fit decreasing and then improved: from the emptiest
container texts are moved, exchanged one for one or two for one with texts of
fuller containers wherever that raises the sum of squared fills, until
containers run empty. Containers still underfull after that are dealt into new
groups and searched again, as long as that empties any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotable.llm.tokenize_corpus import TOKENIZER_DIR, VOCABULARY, count_tokens, encoder
from heliotable.plans.durable import cut
from heliotable.plans.joins import spread

CAPACITY = 2048
#: Rows in a group: the bound of what one task holds at a time.
GROUP_ROWS = 4000
#: Containers filled less than this share are searched again among those of other groups.
WELL_FILLED = 0.985


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    slack = np.full(len(sizes) + 1, capacity, dtype=np.int64)
    for i in order:
        b = int(np.argmax(slack >= sizes[i]))
        bins[i] = b
        slack[b] -= sizes[i]
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Containers after moves and exchanges that raise the sum of squared fills."""
    sizes, bins = sizes.astype(np.int64), bins.copy()
    if not len(sizes):
        return bins
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    done = fill >= capacity
    done |= np.bincount(bins, minlength=len(fill)) == 0
    while not done.all():
        weak = int(np.argmin(np.where(done, capacity + 1, fill)))
        done[weak] = True
        while True:
            mine = np.flatnonzero((bins == weak) & (sizes > 0))
            if not len(mine):
                break
            slack = capacity - fill
            slack[weak] = -1
            slack[fill == 0] = -1
            slack[fill < fill[weak]] = -1  # only towards fuller ones: each step raises the squares
            # a move into the tightest place it fits, the largest first
            moved = False
            for i in mine[np.argsort(-sizes[mine])]:
                room = np.where(slack >= sizes[i], slack, capacity + 1)
                b = int(np.argmin(room))
                if room[b] <= capacity:
                    bins[i] = b
                    fill[b] += sizes[i]
                    fill[weak] -= sizes[i]
                    moved = True
                    break
            if moved:
                continue
            others = np.flatnonzero((slack[bins] > 0) & (sizes > 0))
            if not len(others):
                break
            room, size = slack[bins[others]], sizes[others]
            gives = {int(sizes[i]): (i,) for i in mine}
            small = sizes[mine]
            # of pairs of one total the first stands for all: the exchange knows totals alone
            for x, i in enumerate(mine[:-1]):
                both, at = np.unique(small[x + 1 :] + sizes[i], return_index=True)
                for total, y in zip(both.tolist(), at.tolist()):
                    gives.setdefault(total, (i, mine[x + 1 + y]))
            best, choice = 0, None
            for total, items in gives.items():
                if total <= best:
                    continue  # no exchange gains more than it gives
                gain = np.where((total > size) & (total - size <= room), total - size, 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, choice = int(gain[k]), (items, int(others[k]))
            if choice is None:
                break
            items, other = choice
            b = int(bins[other])
            bins[list(items)] = b
            bins[other] = weak
            fill[b] += best
            fill[weak] -= best
    return bins


def _pack(capacity: int, again: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        some = sizes > 0
        bins = np.zeros(len(pdf), dtype=np.int64)
        start = pd.factorize(pdf["container_id"])[0][some] if again else first_fit_decreasing(sizes[some], capacity)
        bins[some] = local_search(sizes[some], start, capacity)
        # texts without tokens take no room: they are spread over the containers there are
        used = np.unique(bins[some]) if some.any() else np.zeros(1, dtype=np.int64)
        bins[~some] = used[np.arange((~some).sum()) % len(used)]
        number = pd.factorize(bins)[0]
        first = int(pdf["round_group"].iloc[0]) << 16  # a group has far fewer containers
        return pdf.assign(container_id=first + number)[["doc_id", "row", "piece", "start", "n_tokens", "container_id"]]

    return run


_ITEM = "doc_id bigint, row bigint, piece int, start bigint, n_tokens bigint, container_id bigint"


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, row, piece, start, n_tokens, container_id`` from ``doc_id, n_tokens``.

    Every row comes out, rows of equal or null doc_id too, told apart by ``row``,
    which is an own column of ``items`` or else numbered here. A text within the
    capacity lies whole in one container (piece 0, start 0). A longer one alone
    is split: full pieces, each a container, and the rest, which is an item like
    others. A text without tokens (null, empty) is put with others and takes no
    room. An empty table gives no containers.
    """
    cap = F.lit(capacity).cast("long")
    n = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    row = F.col("row").cast("long") if "row" in items.columns else F.monotonically_increasing_id()
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_tokens"), row.alias("row"))
    rows = cut(rows)
    pieces = F.when(F.col("n_tokens") <= cap, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / cap).cast("int") - 1))
    parts = rows.withColumn("piece", F.explode(pieces)).withColumn("start", F.col("piece") * cap).withColumn("n_tokens", F.least(cap, F.col("n_tokens") - F.col("start")))
    total = parts.count()

    def grouped(df: DataFrame, count: int, turn: int) -> DataFrame:
        groups = max(1, -(-count // group_rows))
        key = F.col("container_id") if turn else F.col("row")
        return df.withColumn("round_group", F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(groups)) + (F.lit(turn).cast("long") * F.lit(1 << 36)))

    done = cut(grouped(parts.withColumn("container_id", F.lit(0).cast("long")), total, 0).groupBy("round_group").applyInPandas(_pack(capacity, False), _ITEM))
    kept, turn, before = None, 0, None
    while True:  # underfull containers meet those of other groups until that empties none; their number falls each time, so it ends
        fills = done.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("n"))
        under = cut(fills.where(F.col("fill") < WELL_FILLED * capacity))
        number, rows_left = under.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if number < 2 or (before is not None and number >= before):
            break
        filled = done.join(spread(under.select("container_id")), "container_id", "left_anti").select(*done.columns)
        kept = filled if kept is None else kept.unionByName(filled)
        loose = done.join(spread(under.select("container_id")), "container_id", "left_semi")
        turn, before = turn + 1, number
        done = cut(grouped(loose, rows_left, turn).groupBy("round_group").applyInPandas(_pack(capacity, True), _ITEM))
    out = done if kept is None else kept.unionByName(done)
    return out.select("doc_id", "row", "piece", "start", "n_tokens", "container_id")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The texts of documents packed by their tokens of the byte-level vocabulary of problem 7."""
    return pack(count_tokens(documents), capacity)


def _pieces(capacity: int, folder: str, vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(folder, vocabulary)
        for pdf in batches:
            out = []
            for text, start, n in zip(pdf["text"], pdf["start"], pdf["n_tokens"]):
                if text and (start or n == capacity):
                    text = coder.decode_bytes(coder.encode_ordinary(text)[start : start + n]).decode("utf-8", "replace")
                out.append(text)
            yield pdf.assign(text=out)

    return run


def packed_texts(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, n_tokens, container_id, text``: every text in its container, a longer one cut into its pieces.

    Rows keep their own texts, whether their doc_id is repeated or null. A piece
    is the text of its own tokens; a sign that a cut splits shows in both pieces
    as the sign for what cannot be read.
    """
    numbered = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")))
    sizes = count_tokens(numbered, "row").select(F.col("doc_id").alias("row"), "n_tokens").join(spread(numbered.select("row", "doc_id")), "row")
    both = pack(sizes, capacity).join(spread(numbered.select("row", "text")), "row").select("doc_id", "piece", "start", "n_tokens", "container_id", "text")
    kind = "doc_id bigint, piece int, start bigint, n_tokens bigint, container_id bigint, text string"
    return both.mapInPandas(_pieces(capacity, folder, vocabulary), kind)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each container: what it holds, in order of doc_id, its fill and the room left.

    A container's list is bounded: by the capacity, and for texts without tokens by the group.
    """
    item = F.struct("doc_id", "piece", "start", "n_tokens")
    return packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").cast("int").alias("n_texts"), F.array_sort(F.collect_list(item)).alias("texts")).withColumn("free_tokens", F.lit(capacity) - F.col("used_tokens"))
