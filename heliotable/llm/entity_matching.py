"""Matching lines of machine-made and official estimates without a common number (problem 1).

Method: loopy belief propagation over candidate pairs with one-to-one factors.
Candidates come from equi-joins; each pair has prior odds from several partial,
noisy attributes; every record on either side is a factor that allows one of
its pairs at most. Messages are exchanged through joins until they converge,
and the marginal match probability of every pair is reported. It is run twice:
on the estimates of a project, then on the lines within matched estimates.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliotable.llm import canonical_mapping, work_terms
from heliotable.llm.visual_text import NOT_BLANK, consistent_form
from heliotable.plans.durable import cut
from heliotable.plans.joins import spread
from heliotable.plans.tables import dealt

#: The change of beliefs that counts as none; rounds within which messages must rest, or there is an error, never a result.
STILL, MOST_ROUNDS = 1e-3, 1000

# Kinds of building in the name of a site.
BUILDINGS = "第[一二三四五]工場|工場|物流センター|配送センター|センター|営業所|研修所|体育館|市場棟|倉庫|店|支店|本社|校舎|病院"
_SITE = re.compile(rf"([一-鿿々]{{2,}}?)({BUILDINGS})(?![一-鿿])|([一-鿿々]{{2,}}?)({BUILDINGS})")
# How the kind of work is named after the site.
_KIND = re.compile(r"(?:屋根上|自家消費型|カーポート型)?(?:太陽光|ソーラー|pv)(?:発電)?(?:設備|・?蓄電池)?(?:設置|新設|併設)?工事|(?:御|お)?見積書?|最終版?|_?rev\.?\d+|\((?:見積|最終)\)")
_PHASE = re.compile(r"第?([0-9一二三四五六七八九])(?:期|次)(?:工事|計画)?")
_LEGAL = re.compile(r"株式会社|有限会社|合同会社|\((?:株|有|同)\)|様$|御中$|殿$|さん$")


def _plain(text: str | None) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", consistent_form(text) or "").lower())


def client_key(text: str | None) -> str:
    """A client's name without legal form and honorific. Null gives ''."""
    t = _plain((text or "").replace("㈱", "(株)"))
    for _ in range(2):
        t = _LEGAL.sub("", t)
    return t


def phase_of(text: str) -> str:
    m = _PHASE.search(text)
    if m:
        return str("〇一二三四五六七八九".find(m[1])) if m[1] in "一二三四五六七八九" else m[1]
    return "more" if "増設" in text else ""


def date_of(text: str | None) -> tuple[int | None, int | None]:
    """(day number, day of the year); the first is None where no year is written, both for no date."""
    t = unicodedata.normalize("NFKC", text or "").strip().lower()
    m = re.search(r"(\d{4})[年/.\-](\d{1,2})[月/.\-](\d{1,2})", t)
    era = re.search(r"(r|令和)\s*(\d{1,2})[年/.\-](\d{1,2})[月/.\-](\d{1,2})", t)
    short = re.search(r"(?<!\d)(\d{1,2})[月/](\d{1,2})", t)
    try:
        if era:
            day = dt.date(2018 + int(era[2]), int(era[3]), int(era[4]))
        elif m:
            day = dt.date(*map(int, m.groups()))
        elif short:
            return None, dt.date(2024, int(short[1]), int(short[2])).timetuple().tm_yday
        else:
            return None, None
    except ValueError:
        return None, None
    return day.toordinal(), day.timetuple().tm_yday


def header(client: str | None, project: str | None, file_name: str | None, issued: str | None) -> tuple:
    """(client, site, phase, site in the file's name, day, day of year); '' and None for what is missing.

    The site is what stands before the kind of building; in a name without a
    known kind it is the whole of the name besides client, kind of work and phase.
    """
    name = _KIND.sub(" ", _plain(project)).strip()
    own = client_key(client)
    if own and name.startswith(own):
        name = name[len(own) :].strip()
    sites = [m for m in _SITE.finditer(name)]
    site = (sites[-1][1] or sites[-1][3]) if sites else re.sub(r"\s+|\(増設分?\)", "", _PHASE.sub("", name)) if project else ""
    if not own and sites:
        own = client_key(name[: name.find(site)])
    stem = re.sub(r"^見積書_|\.\w+$", "", _plain(file_name))
    m = _SITE.search(stem)
    filed = (m[1] or m[3]) if m else stem if re.fullmatch("[一-鿿々]{3,}", stem) else ""
    return (own, site, phase_of(_plain(project)), filed, *date_of(issued))


def endings(site: str, source: str) -> set[str]:
    """What a site may be: as it stands, and where people typed it, with less of what may be a client's name before it."""
    return {site} | ({site[k:] for k in range(1, len(site) - 2)} if source == "official" else set())


HEADER = "doc_id string, source string, client string, site string, phase string, filed string, day int, yearday int, total long, branch string, named boolean"
KEYS = "doc_id string, key string"
#: Days in a stretch of time by which a client's estimates are told apart before they meet.
STRETCH = 61


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in HEADER.split(", ")]
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            h = header(r.client_name, r.project_name, r.file_name, r.issue_date)
            rows.append((r.doc_id, r.source, *h, r.total_before_tax, r.branch_code or "", bool(h[1] or h[3])))
        out = pd.DataFrame(rows, columns=names)
        for c in ("day", "yearday", "total"):
            out[c] = out[c].astype("Int64")
        yield out


def _site_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, source, client, site, filed, phase in zip(*[pdf[c] for c in ("doc_id", "source", "client", "site", "filed", "phase")]):
            # a slip of typing spares one end of the client's name, so a site that many clients have falls apart by client
            ends = {client[:2] + "<", ">" + client[-2:], client[0] + "|" + client[-1]} if client else {"*"}
            # an official one without a client meets every other of its site, and so does an AI one
            ends |= ({"*"} if client else {"*", "?"}) if source == "ai" else {"?"}
            # a stated name states its phase, or that it has none; known by its file alone an official one may be any phase
            phases = ({"#" + phase} if site else {"?"}) | ({"?"} if source == "ai" else set())
            for s in (endings(site, source) | {filed}) - {""}:
                keys = {"=" + "".join(sorted(s)) + end for end in ends}
                if client and len(s) > 3:
                    keys |= {client + "~" + "".join(c) for c in combinations(sorted(s), len(s) - 1)}
                rows += [(doc, k + p) for k in keys for p in phases]
        yield pd.DataFrame(rows, columns=["doc_id", "key"])


def belief(edges: DataFrame, most_rounds: int = MOST_ROUNDS, still: float = STILL) -> DataFrame:
    """``left_id, right_id, match_score, rounds`` of candidate pairs with prior ``odds``: their marginal match probabilities.

    Every left and every right record is in one pair at most. Pairs that
    compete with none are exact at once; the messages of the others go round,
    summed for each record by a grouped sum and joined back, so that no record's
    pairs are ever gathered. Sides take turns, by which messages move one way
    only and come to rest; they go on until no belief moves by ``still``. If
    they did not within ``most_rounds``, that is an error. Equal pairs count
    once, with their greatest odds.
    """
    edges = cut(edges.groupBy("left_id", "right_id").agg(F.max("odds").alias("odds")))
    by_left = edges.groupBy("left_id").agg(F.count("*").alias("left_n"))
    by_right = edges.groupBy("right_id").agg(F.count("*").alias("right_n"))
    edges = cut(edges.join(spread(by_left), "left_id").join(spread(by_right), "right_id"))
    alone = edges.where("left_n = 1 and right_n = 1").select("left_id", "right_id", (F.col("odds") / (1 + F.col("odds"))).alias("match_score"), F.lit(0).alias("rounds"))
    state = edges.where("left_n > 1 or right_n > 1").select("left_id", "right_id", "odds", F.col("odds").alias("to_left"), F.lit(0.0).alias("match_score"))
    for k in range(1, most_rounds + 1):
        left = state.groupBy("left_id").agg(F.sum("to_left").alias("sum_left"))
        half = state.join(spread(left), "left_id").withColumn("from_left", 1 / (1 + F.greatest(F.lit(0.0), F.col("sum_left") - F.col("to_left"))))
        half = half.withColumn("to_right", F.col("odds") * F.col("from_left")).drop("sum_left")
        right = half.groupBy("right_id").agg(F.sum("to_right").alias("sum_right"))
        full = half.join(spread(right), "right_id").withColumn("from_right", 1 / (1 + F.greatest(F.lit(0.0), F.col("sum_right") - F.col("to_right"))))
        weight = F.col("odds") * F.col("from_left") * F.col("from_right")
        new = full.withColumn("belief", weight / (1 + weight)).withColumn("moved", F.abs(F.col("belief") - F.col("match_score")))
        new = new.select("left_id", "right_id", "odds", (F.col("odds") * F.col("from_right")).alias("to_left"), F.col("belief").alias("match_score"), "moved")
        if k % 2 and k < most_rounds:  # lineage is cut and rest looked for every second round
            state = new.drop("moved")
            continue
        new = cut(new)
        moved = new.agg(F.max("moved")).first()[0]
        state = new.drop("moved")
        if moved is None or moved < still:
            return alone.unionByName(state.select("left_id", "right_id", "match_score", F.lit(k).alias("rounds")))
    raise RuntimeError(f"beliefs still move by {moved} after {most_rounds} rounds")


def mutual_best(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """The pairs that are the best of both their records, at ``least`` as sure. Ties go to the smaller ids."""
    left = W.partitionBy("left_id").orderBy(F.desc("match_score"), "right_id")
    right = W.partitionBy("right_id").orderBy(F.desc("match_score"), "left_id")
    ranked = scored.where(F.col("match_score") >= least).withColumn("l", F.row_number().over(left)).withColumn("r", F.row_number().over(right))
    return ranked.where("l = 1 and r = 1").drop("l", "r")


def _signs(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, _ = canonical_mapping._built(shared.value)
        known: dict[str, str] = {}
        for pdf in batches:
            items, specs, places = [], [], []
            for d, r in zip(pdf["description"], pdf["remarks"]):
                k = work_terms.plain_words(d)
                if k not in known:
                    if len(known) >= canonical_mapping.KEPT_ANSWERS:
                        known.clear()
                    known[k] = canonical_mapping.nearest(trie, k)[0] or k.rstrip("費")
                items.append(known[k])
                specs.append("+".join(work_terms.specification(d, r)))
                places.append(work_terms.rest_of_remarks(r))
            yield pdf.assign(item=items, spec=specs, place=places)

    return run


# Rows that sum others up are no work items.
_SUMS = r"^[\s【\[(（■・※]*(小計|合計|総計|計|直接工事費計|工事費計|中計|総合計)[\s】\])）]*$"


def line_signs(lines: DataFrame, paths: list[tuple[str, str]]) -> DataFrame:
    """Lines with their work item, specification and place. Each line_id once; blank lines and sums are left out."""
    rows = lines.where("line_id is not null and doc_id is not null").where(F.col("description").rlike(NOT_BLANK)).where(~F.col("description").rlike(_SUMS)).select("line_id", "doc_id", "source", "pos", "description", "remarks", "quantity_value", "unit_price").dropDuplicates(["line_id"])
    shared = lines.sparkSession.sparkContext.broadcast(tuple(paths))
    texts = dealt(rows.select("description", "remarks").distinct()).mapInPandas(_signs(shared), "description string, remarks string, item string, spec string, place string")
    same = (rows["description"] == texts["description"]) & rows["remarks"].eqNullSafe(texts["remarks"])
    return rows.join(spread(texts), same).select("line_id", "doc_id", rows["source"], "pos", "item", "spec", "place", "quantity_value", "unit_price").where("item <> ''")


def document_candidates(headers: DataFrame) -> DataFrame:
    """``ai_doc, official_doc`` that may be of one project: one site by its signs, or, where no site is stated, one client near in time."""
    keys = headers.mapInPandas(_site_keys, KEYS)
    source = headers.select("doc_id", "source")
    keys = keys.join(spread(source), "doc_id")
    ai = keys.where("source = 'ai'").select("key", F.col("doc_id").alias("ai_doc"))
    official = keys.where("source = 'official'").select("key", F.col("doc_id").alias("official_doc"))
    by_site = ai.join(spread(official), "key").select("ai_doc", "official_doc").distinct()
    bare = headers.where("source = 'official' and not named and client <> ''").select(F.col("doc_id").alias("official_doc"), "client", F.col("day").alias("o_day"), F.col("yearday").alias("o_yearday"))
    any_ai = headers.where("source = 'ai' and client <> ''").select(F.col("doc_id").alias("ai_doc"), "client", F.col("day").alias("a_day"), F.col("yearday").alias("a_yearday"))
    # a client's estimates fall apart by stretches of time: of days where the year is known, of the year where it is not
    stretch = lambda c, at: F.floor(F.col(c) / at)
    stretches = lambda c, low, high: F.sequence(F.floor((F.col(c) - low) / STRETCH), F.floor((F.col(c) + high) / STRETCH))
    of_year = F.transform(F.sequence(F.col("o_yearday") - 100, F.col("o_yearday") + 10), lambda d: F.floor(F.pmod(d, F.lit(366)) / STRETCH))
    days = F.transform(stretches("o_day", 100, 10), lambda k: F.concat(F.lit("d"), k))
    years = F.transform(F.array_distinct(of_year), lambda k: F.concat(F.lit("y"), k))
    wanted = F.when(F.col("o_day").isNotNull(), F.concat(days, F.array(F.lit("none")))).when(F.col("o_yearday").isNotNull(), F.concat(years, F.array(F.lit("none")))).otherwise(F.array(F.lit("any")))
    # (an AI estimate of an unknown day meets every official one, one of a known day those of its stretches and those without a day)
    given = F.when(F.col("a_day").isNotNull(), F.array(F.concat(F.lit("d"), stretch("a_day", STRETCH)), F.concat(F.lit("y"), stretch("a_yearday", STRETCH)), F.lit("any")))
    given = given.when(F.col("a_yearday").isNotNull(), F.array(F.concat(F.lit("y"), stretch("a_yearday", STRETCH)), F.lit("none"), F.lit("any"))).otherwise(F.array(F.lit("none"), F.lit("any")))
    gap = F.col("o_day") - F.col("a_day")
    around = F.pmod(F.col("o_yearday") - F.col("a_yearday"), F.lit(365))
    near = F.when(gap.isNotNull(), gap.between(-10, 100)).when(around.isNotNull(), (around <= 100) | (around >= 355)).otherwise(True)
    met = bare.withColumn("stretch", F.explode(wanted)).join(spread(any_ai.withColumn("stretch", F.explode(given))), ["client", "stretch"])
    return by_site.unionByName(met.where(near).select("ai_doc", "official_doc")).distinct()


def _matched(documents: DataFrame, lines: DataFrame, paths: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """The estimates of a project, and the lines of all candidates that state the same work."""
    columns = ["doc_id", "source", "client_name", "project_name", "file_name", "issue_date", "total_before_tax", "branch_code"]
    docs = documents.where("doc_id is not null").select(*columns).dropDuplicates(["doc_id"])
    headers = cut(dealt(docs).mapInPandas(_headers, HEADER))
    signs = cut(line_signs(lines, paths))
    sizes = signs.groupBy("doc_id").agg(F.count("*").alias("lines"))

    def side(prefix: str, name: str) -> DataFrame:
        own = headers.join(spread(sizes), "doc_id", "left").select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("client", "site", "phase", "filed", "day", "yearday", "total", "branch", "named", "lines")], F.col("doc_id").alias(name))
        return own

    pairs = document_candidates(headers).join(spread(side("a", "ai_doc")), "ai_doc").join(spread(side("o", "official_doc")), "official_doc")
    # a phase that is stated, or the lack of one in a stated name, tells projects of one site apart
    pairs = cut(pairs.where("o_site = '' or a_phase = o_phase"))
    ai = signs.where("source = 'ai'").select(F.col("doc_id").alias("ai_doc"), "item", "spec", F.col("line_id").alias("a_line"), F.col("place").alias("a_place"), F.col("quantity_value").alias("a_qty"), F.col("unit_price").alias("a_price"), F.col("pos").alias("a_pos"))
    official = signs.where("source = 'official'").select(F.col("doc_id").alias("official_doc"), "item", "spec", F.col("line_id").alias("o_line"), F.col("place").alias("o_place"), F.col("quantity_value").alias("o_qty"), F.col("unit_price").alias("o_price"), F.col("pos").alias("o_pos"))
    fit = (F.col("a_place") == F.col("o_place")) | (F.col("a_place") == "") | (F.col("o_place") == "")
    met = cut(pairs.select("ai_doc", "official_doc").join(spread(ai), "ai_doc").join(spread(official), ["official_doc", "item", "spec"]).where(fit))
    shared = met.groupBy("ai_doc", "official_doc").agg(F.countDistinct("a_line").alias("a_met"), F.countDistinct("o_line").alias("o_met"), F.count_distinct(F.when(F.col("a_qty") == F.col("o_qty"), F.col("a_line"))).alias("same_qty"))
    pairs = pairs.join(spread(shared), ["ai_doc", "official_doc"], "left")

    # of a site typed with more before it, so much counts as the other has signs
    typed = F.when(F.col("o_site") == "", F.col("o_filed")).when(F.length("o_site") > F.length("a_site"), F.expr("right(o_site, length(a_site))")).otherwise(F.col("o_site"))
    same_signs = F.when(F.array_sort(F.split("a_site", "")) == F.array_sort(F.split(typed, "")), 3.0).when(F.col("a_site") == F.col("o_filed"), 2.5).when(F.col("o_named"), 0.0).otherwise(-1.0)
    apart = F.levenshtein("a_client", "o_client")
    client = F.when((F.col("a_client") == "") | (F.col("o_client") == ""), 0.0).when(apart == 0, 2.0).when(apart <= 2, 1.0).otherwise(-3.0)
    gap = F.col("o_day") - F.col("a_day")
    around = F.pmod(F.col("o_yearday") - F.col("a_yearday"), F.lit(365))
    date = F.when(gap.between(0, 75), 1.0).when(gap.isNotNull(), -1.5).when((around <= 75), 0.7).when(around.isNotNull(), -1.0).otherwise(0.0)
    ratio = F.abs(F.log(F.col("o_total") / F.col("a_total")))
    total = F.when((F.col("a_total") <= 0) | (F.col("o_total") <= 0), 0.0).when(ratio < 0.25, 1.0).when(ratio.isNotNull(), -0.3).otherwise(0.0)
    branch = F.when((F.col("a_branch") == "") | (F.col("o_branch") == ""), 0.0).when(F.col("a_branch") == F.col("o_branch"), 1.0).otherwise(-0.5)
    share = F.coalesce(F.least("a_met", "o_met"), F.lit(0)) / F.greatest(F.lit(1), F.least(F.coalesce("a_lines", F.lit(0)), F.coalesce("o_lines", F.lit(0))))
    overlap = F.when(F.col("o_named"), 3.0 * share - 1.0).otherwise(9.0 * share + 0.25 * F.coalesce("same_qty", F.lit(0)) - 6.5)
    logit = same_signs + client + date + total + branch + overlap - 2.0
    doc_edges = pairs.select(F.col("ai_doc").alias("left_id"), F.col("official_doc").alias("right_id"), F.exp(logit).alias("odds"))
    matched = cut(mutual_best(belief(doc_edges)).select(F.col("left_id").alias("ai_doc"), F.col("right_id").alias("official_doc"), F.col("match_score").alias("doc_score")))
    return matched, met


def matched_documents(documents: DataFrame, lines: DataFrame, paths: list[tuple[str, str]]) -> DataFrame:
    """``ai_doc, official_doc, doc_score``: the two estimates of a project, each in one pair."""
    return _matched(documents, lines, paths)[0]


def match_lines(documents: DataFrame, lines: DataFrame, paths: list[tuple[str, str]]) -> DataFrame:
    """``line_a, line_b, match_score, rounds``: lines that state the same work item in the two estimates of a project.

    ``line_a`` is the smaller id; ``rounds`` are those after which no belief
    moved any more, 0 for a pair that competed with none. Estimates and lines delivered again count
    once; null and blank fields are missing evidence, neither for nor against.
    """
    matched, met = _matched(documents, lines, paths)
    inside = met.join(spread(matched), ["ai_doc", "official_doc"])
    place = F.when(F.col("a_place") == F.col("o_place"), 1.5).otherwise(0.0)
    quantity = F.when(F.col("a_qty") == F.col("o_qty"), 1.0).otherwise(0.0)
    price = F.when(F.abs(F.log(F.col("a_price") / F.col("o_price"))) < 0.25, 0.7).otherwise(0.0)
    order = -0.02 * F.abs(F.col("a_pos") - F.col("o_pos"))
    line_odds = F.exp(1.5 + place + quantity + price + F.coalesce(order, F.lit(0.0))) * F.col("doc_score")
    edges = inside.select(F.col("a_line").alias("left_id"), F.col("o_line").alias("right_id"), line_odds.alias("odds"))
    best = mutual_best(belief(edges), least=0.05)
    return best.select(F.least("left_id", "right_id").alias("line_a"), F.greatest("left_id", "right_id").alias("line_b"), "match_score", "rounds")
