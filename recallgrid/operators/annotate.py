"""Annotation jobs: rules, dates and JSON replies as columns and rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx
from . import lexical
from .textjobs import _trim, _words


def _any(text: Column, phrases: list[str]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in phrases))


def _found(text: Column, alternatives: list[str], tail: list[str] = ()) -> Column:
    rx = "|".join([rf"\b(?:{'|'.join(alternatives)})\b", *tail])
    return F.regexp_extract_all(text, F.lit(f"(?iU)({rx})"), 1)


def annotate_queries(queries: DataFrame, text: str = "text") -> DataFrame:
    """Type, features, language, channel weights, complexity and counting flag."""
    c = F.col(text)
    low = F.lower(c)
    n_words = F.size(_words(c))
    nouns = F.filter(F.regexp_extract_all(c, F.lit(r"(?U)(\b\p{Lu}[\p{L}\p{N}_]*\b)"), 1), lambda w: ~F.lower(w).isin(lx.QUESTION_WORDS))
    q = queries.withColumn("entities", nouns).withColumn("time_marks", _found(c, lx.TIME_PHRASES, lx.TIME_NUMBERS)).withColumn(
        "lookup_verbs", _found(c, lx.DOCUMENT_PHRASES)).withColumn("recent_marks", _found(c, lx.RECENT_WORDS)).withColumn(
        "relation_words", _found(c, lx.RELATION_WORDS))
    q = q.withColumn("query_type", F.when(F.size("lookup_verbs") > 0, "lookup").when(
        (F.size("entities") >= 2) & (F.size("relation_words") > 0), "relational").when(F.size("time_marks") > 0, "temporal").when(
        F.size("recent_marks") > 0, "recent").otherwise("factual"))
    score = lambda marks: reduce(lambda a, b: a + b, [low.contains(m).cast("int") for m in marks])
    pl, en = score(lx.POLISH_MARKERS), score(lx.ENGLISH_MARKERS)
    q = q.withColumn("language", F.when(c.rlike(f"[{lx.POLISH_LETTERS}]") | (pl > en), "pl").when(en > pl, "en"))
    q = q.withColumn("complexity", F.when(_any(low, lx.PROFILE_PHRASES), "profile").when(_any(low, lx.AGGREGATION_PHRASES), "aggregation").when(
        _any(low, lx.COMPLEX_PHRASES) | (n_words > 15), "complex").when(_any(low, lx.TEMPORAL_PHRASES), "temporal").when(
        n_words.between(5, 15), "medium").otherwise("simple"))
    q = q.withColumn("counting", ~_any(low, lx.PREFERENCE_PHRASES) & _any(low, lx.COUNTING_PHRASES))
    for i, channel in enumerate(lx.CHANNELS):
        table = F.create_map(*[F.lit(v) for kind, row in lx.CHANNEL_WEIGHTS.items() for v in (kind, row[i] / sum(row))])
        q = q.withColumn(f"w_{channel}", F.round(F.element_at(table, F.col("query_type")), 6))
    return q


def fact_type(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(_any(low, lx.PREFERENCE_FACTS), "preference_or_decision").when(_any(low, lx.EXPERIENCE_FACTS), "experience")
            .when(_any(low, lx.PROJECT_FACTS), "project_state").otherwise("fact"))


def trust_level(agent: Column) -> Column:
    """Trust of a source; none is `a1`, an unknown one `b`."""
    out = F.lit("b")
    for source, tier in lx.TRUST_OF_SOURCE.items():
        out = F.when(agent == source, tier).otherwise(out)
    return F.when(agent.isNull(), "a1").otherwise(out)


def written_trust(agent: Column, honour_caller: bool) -> Column:
    """Trust of a row an agent writes: never `a1` unless its word counts."""
    t = trust_level(agent)
    return t if honour_caller else F.when(t == "a1", "a2").otherwise(t)


def trust_rank(level: Column) -> Column:
    out = F.lit(0)
    for tier, rank in lx.TRUST_RANK.items():
        out = F.when(F.coalesce(level, F.lit("a1")) == tier, rank).otherwise(out)
    return out


def stream_kind(stream: Column) -> Column:
    return F.when(stream.startswith("__shared_"), "shared").when(stream.startswith("__project_"), "project").otherwise("private")


def relation_label(raw: Column) -> Column:
    """Canonical label of a raw relation, `related_to` when unknown."""
    low = F.lower(_trim(raw))
    return F.when(low.isin(lx.RELATIONS), low).otherwise("related_to")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _month(name: Column, lists: list[list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for names in lists:
        for i, n in enumerate(names):
            out = F.when(name == n, F.lit(str(i + 1))).otherwise(out)
    return out


def resolve_dates(table: DataFrame, raw: str, anchor: str) -> DataFrame:
    """Adds `branch` and `resolved`: the day a phrase means, seen from `anchor` (a date)."""
    s, a = F.lower(_trim(F.col(raw))), F.col(anchor)
    part = lambda rx, i: F.regexp_extract(F.col("_s"), rx, i)
    iso, dotted, slashed = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"^(\d{4})/(\d{1,2})/(\d{1,2})\b"
    polish_months = [lx.POLISH_MONTHS, [m.replace("ś", "s").replace("ź", "z") for m in lx.POLISH_MONTHS]]
    all_pl = sorted({m for names in polish_months for m in names})
    pl = rf"^(\d{{1,2}})\s+({'|'.join(all_pl)})(?:\s+(\d{{4}}))?$"
    en = rf"^({'|'.join(lx.ENGLISH_MONTHS)})\s+(\d{{1,2}})(?:\s*,?\s*(\d{{4}}))?$"
    ago_d, ago_w = r"^(\d+)\s+(?:days?\s+ago|(?:dzień|dnia|dni)\s+temu)$", r"^(\d+)\s+(?:weeks?\s+ago|(?:tygodnie|tygodnia|tygodni|tydzień)\s+temu)$"
    ago_m = r"^(\d+)\s+(?:months?\s+ago|miesi[ąęe]c(?:y|e|a|)\s+temu)$"
    wd_en = rf"^last\s+({'|'.join(lx.ENGLISH_WEEKDAYS)})$"
    wd_pl = rf"^w\s+zesz[łl][yą]\s+({'|'.join(n for names in lx.POLISH_WEEKDAYS for n in names)})$"

    def month_day(m: Column, d: Column, y: Column) -> Column:
        """With no year: the latest such day not after the anchor's, in its year or the one before."""
        this = _date(F.year(a).cast("string"), m, d)
        before = _date((F.year(a) - 1).cast("string"), m, d)
        return F.when(y != "", _date(y, m, d)).otherwise(F.when(this <= a, this).otherwise(before))

    def weekday(target: Column) -> Column:
        back = F.pmod(F.weekday(a) - target, F.lit(7))
        return F.date_sub(a, F.when(back == 0, 7).otherwise(back).cast("int"))

    def weekday_number(name: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, (e, p) in enumerate(zip(lx.ENGLISH_WEEKDAYS, lx.POLISH_WEEKDAYS)):
            out = F.when(name.isin([e, *p]), i).otherwise(out)
        return out

    # branch -> (pattern, group of year, month, day) or (pattern, group of the number or weekday)
    dated = {"iso": (iso, 1, 2, 3), "dotted": (dotted, 3, 2, 1), "slashed": (slashed, 1, 2, 3), "polish_month": (pl, 3, 2, 1), "english_month": (en, 3, 1, 2)}
    counted = {"days_ago": ago_d, "weeks_ago": ago_w, "months_ago": ago_m}
    weekdays = {"last_weekday": wd_en, "last_weekday_pl": wd_pl}
    words = {"today": r"^(today|dziś|dzisiaj|dzis)$", "yesterday": r"^(yesterday|wczoraj)$", "day_before": r"^(day before yesterday|przedwczoraj)$",
             "tomorrow": r"^(tomorrow|jutro)$", "last_week": r"^(last week|w zesz[łl]ym tygodniu)$",
             "last_month": r"^(last month|w zeszłym miesiącu|w zeszlym miesiacu)$"}
    patterns = {**{k: v[0] for k, v in dated.items()}, **words, **counted, **weekdays}
    branch = F.coalesce(*[F.when(F.col("_s").rlike(rx), F.lit(k)) for k, rx in patterns.items()], F.lit("none"))
    is_ = lambda *names: F.col("branch").isin(*names)
    pick = lambda table, group: F.coalesce(*[F.when(is_(k), part(rx, g)) for k, (rx, g) in ((k, group(v)) for k, v in table.items())])
    t = table.withColumn("_s", s).withColumn("branch", branch)
    # the parts first, so that each date rule is written once
    t = t.withColumn("_y", pick(dated, lambda v: (v[0], v[1]))).withColumn("_mm", pick(dated, lambda v: (v[0], v[2]))).withColumn(
        "_d", pick(dated, lambda v: (v[0], v[3]))).withColumn("_n", pick(counted, lambda v: (v, 1)).try_cast("int")).withColumn(
        "_wd", weekday_number(pick(weekdays, lambda v: (v, 1))))
    t = t.withColumn("_m", F.when(is_("polish_month", "english_month"), _month(F.col("_mm"), [*polish_months, lx.ENGLISH_MONTHS])).otherwise(F.col("_mm")))
    shift = F.when(is_("today"), 0).when(is_("yesterday"), -1).when(is_("day_before"), -2).when(is_("tomorrow"), 1).when(
        is_("days_ago"), -F.col("_n")).when(is_("weeks_ago"), -F.col("_n") * 7)
    value = F.coalesce(
        F.when(is_(*dated), month_day(F.col("_m"), F.col("_d"), F.col("_y"))), F.date_add(a, shift),
        F.when(is_("last_month"), F.add_months(F.trunc(a, "month"), -1)), F.when(is_("months_ago"), F.add_months(a, -F.col("_n"))),
        weekday(F.when(is_("last_week"), 0).otherwise(F.col("_wd"))))
    return t.withColumn("resolved", value).drop("_s", "_y", "_mm", "_m", "_d", "_n", "_wd")


def event_seconds(iso: Column) -> Column:
    """Midnight UTC of an ISO date; null when unreadable or before 1970."""
    day = F.unix_date(F.try_to_date(_trim(iso), "yyyy-MM-dd")).cast("long") * 86400
    return F.when(day >= 0, day)


def query_time_range(queries: DataFrame, now: int, text: str = "text") -> DataFrame:
    """Adds `clean`, `start_ts`, `end_ts`: a day or range taken out of the question."""
    today = now - now % 86400
    patterns = {"iso": r"(\d{4})-(\d{2})-(\d{2})", "dotted": r"(\d{1,2})\.(\d{2})\.(\d{4})",
                "month": rf"(\d{{1,2}})\s+({'|'.join(lx.POLISH_MONTHS)})(?:\s+(\d{{4}}))?"}
    low = F.col("_low")
    ex = lambda kind, i: F.regexp_extract(low, patterns[kind], i)
    year = F.when(ex("month", 3) == "", F.year(F.timestamp_seconds(F.lit(now))).cast("string")).otherwise(ex("month", 3))
    q = queries.withColumn("_low", F.lower(F.col(text)))
    q = q.withColumn("_iso", _date(ex("iso", 1), ex("iso", 2), ex("iso", 3))).withColumn("_dotted", _date(ex("dotted", 3), ex("dotted", 2), ex("dotted", 1)))
    q = q.withColumn("_month", _date(year, _month(ex("month", 2), [lx.POLISH_MONTHS]), ex("month", 1)))
    # words first, then dates, first match wins; each word rule with what it removes and its range
    words = {"today": (["dzisiaj", "dziś"], today, today + 86399), "yesterday": (["wczoraj"], today - 86400, today - 1),
             "week": (["ostatni tydzień", "ostatni tydzie"], now - 7 * 86400, now), "last_month": (["ostatni miesiąc", "ostatni miesią"], now - 30 * 86400, now)}
    rule = F.coalesce(*[F.when(low.rlike("|".join(gone)), F.lit(k)) for k, (gone, _, _) in words.items()],
                      *[F.when(F.col(f"_{k}").isNotNull(), F.lit(k)) for k in patterns], F.lit("none"))
    q = q.withColumn("_rule", rule)
    is_ = lambda k: F.col("_rule") == k

    def without_first(rx: str) -> Column:
        rest = F.regexp_extract(low, f"(?s)^.*?{rx}(.*)$", re.compile(rx).groups + 1)
        return F.concat(F.regexp_extract(low, f"(?s)^(.*?){rx}", 1), rest)

    clean = F.coalesce(*[F.when(is_(k), F.regexp_replace(low, "|".join(gone), "")) for k, (gone, _, _) in words.items()],
                       *[F.when(is_(k), without_first(rx)) for k, rx in patterns.items()])
    day = F.unix_date(F.coalesce(*[F.when(is_(k), F.col(f"_{k}")) for k in patterns])).cast("long") * 86400
    lo = F.coalesce(*[F.when(is_(k), F.lit(a)) for k, (_, a, _) in words.items()], day)
    hi = F.coalesce(*[F.when(is_(k), F.lit(z)) for k, (_, _, z) in words.items()], day + 86399)
    return q.withColumn("clean", F.coalesce(_trim(clean), F.col(text))).withColumn("start_ts", lo).withColumn("end_ts", hi).drop(
        "_low", "_iso", "_dotted", "_month", "_rule")


def rows_in_range(ranges: DataFrame, rows: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Rows whose `ts` lies in a query's range: equal days, then the bounds."""
    q = ranges.where("start_ts is not null").withColumn("day", F.explode(F.expr("sequence(start_ts div 86400, end_ts div 86400)")))
    return q.join(rows.withColumn("day", F.expr(f"{ts} div 86400")), "day").where(F.col(ts).between(F.col("start_ts"), F.col("end_ts"))).drop("day")


def source_tags(table: DataFrame, raw: str) -> DataFrame:
    """Old plain-string and new object sources as one struct, with the form seen."""
    c = F.trim(F.col(raw))
    obj = F.from_json(c, "agent string, session string, channel string")
    text = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    form = F.when(c.isNull() | (c == "null") | (c == ""), "none").when(c.startswith("{"), "object").when(text == "", "none").otherwise("string")
    return table.withColumn("form", form).withColumn("source", F.when(F.col("form") == "object", obj).when(
        F.col("form") == "string", F.struct(text.alias("agent"), F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("channel"))))


FACTS = "facts array<struct<content:string,confidence:double>>"


def ingest_replies(replies: DataFrame, cap: int, min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, failures, outcomes) of model replies, one reply per transcript part.

    Parts are read in order until `cap` facts of enough confidence are found; a
    later part is not looked at, so its failure does not count. `replies` has
    transcript, part, status and reply.
    """
    body = F.regexp_replace(F.trim("reply"), r"^```(json)?|```$", "")
    outer = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(outer, FACTS)["facts"]
    r = replies.withColumn("facts", F.when(F.col("status").between(200, 299), parsed))
    r = r.withColumn("good", F.filter("facts", lambda f: f["confidence"] >= min_confidence))
    w = Window.partitionBy("transcript").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("before", F.coalesce(F.sum(F.coalesce(F.size("good"), F.lit(0))).over(w), F.lit(0))).where(F.col("before") < cap)
    facts = r.select("transcript", "part", "before", F.posexplode("good").alias("i", "f")).withColumn(
        "n", F.col("before") + F.col("i") + 1).where(F.col("n") <= cap).select("transcript", "part", "n", "f.content", "f.confidence")
    failures = r.where("facts is null").select("transcript", "part", "status", F.when(
        F.col("status").between(200, 299), "unreadable").otherwise("status").alias("reason"))
    outcomes = r.groupBy("transcript").agg(
        F.count("*").alias("parts"), F.count_if(F.col("facts").isNull()).alias("failed"),
        F.sum(F.coalesce(F.size("facts"), F.lit(0))).alias("seen"), F.least(F.lit(cap), F.sum(F.coalesce(F.size("good"), F.lit(0)))).alias("kept"))
    outcomes = outcomes.withColumn("outcome", F.when(F.col("failed") == F.col("parts"), "all_failed").when(F.col("kept") > 0, "facts").when(
        F.col("seen") == 0, "empty").otherwise("filtered"))
    return facts, failures, outcomes


def content_types(labels: DataFrame) -> DataFrame:
    """One valid label per row id; others are marked rejected. `labels(id, label, at)`."""
    v = labels.withColumn("label", _trim(F.col("label"))).withColumn("valid", F.col("label").isin(lx.CONTENT_TYPES))
    w = Window.partitionBy("id", "valid").orderBy(F.desc("at"), "label")
    return v.withColumn("rn", F.row_number().over(w)).where("not valid or rn = 1").drop("rn")


def attribute_terms(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, term): words of three letters or more that are no stop word and
    no part of an entity the query names. `names(query_id, name)`."""
    words = lexical.query_terms(queries).where((F.length("token") >= 3) & ~F.col("token").isin(lx.ATTRIBUTE_STOPWORDS))
    inside = words.join(names, "query_id").where(F.lower("name").contains(F.col("token"))).select("query_id", "token")
    return words.join(inside, ["query_id", "token"], "left_anti").select("query_id", F.col("token").alias("term"))
