"""Evaluation of retrieval runs and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import percent
from corpusloom.session import stored


def retrieval_marks(run: DataFrame) -> DataFrame:
    """Adds hit1, hit3, hit5, all_found, some_found and score of runs with expected and got (arrays), and abstain flags."""
    hit = lambda n: F.arrays_overlap(F.slice("got", 1, n), "expected")
    found = run.withColumns({"hit1": hit(1), "hit3": hit(3), "hit5": hit(5)})
    none_missing = (F.size("expected") > 0) & (F.size(F.array_except("expected", F.slice("got", 1, 5))) == 0)
    score = F.when(F.col("should_abstain"), F.when(F.col("abstained"), 1.0).otherwise(0.0)).when(F.col("hit1"), 1.0).when(F.col("hit3"), 0.7).otherwise(0.0)
    return found.withColumns({"all_found": none_missing, "some_found": F.col("hit5"), "score": score})


def positions(run: DataFrame) -> DataFrame:
    """case, url, place of every expected URL in what came back (from 1, 0 where it did not)."""
    return run.select("case", "got", F.explode("expected").alias("url")).select("case", "url", F.array_position("got", F.col("url")).alias("place"))


def breakdown(marks: DataFrame) -> DataFrame:
    """Hit rates in percent by category, by split, by kind of case, by the slice of all three, and of all: one scan, by grouping sets.

    marks: category, split, case_type (single, multi, abstain), expected, got. A case of one
    expected URL is hit if it is among the first 1, 3 or 5; one of several if all are, and
    `partial` counts those of which some, not all, are among the first 5. Abstaining cases count
    in `total` and `abstain` alone, not in `n`, of which the rates are. `level` tells the grouping.
    """
    got = lambda k: F.slice("got", 1, k)
    asked = (F.col("case_type") != "abstain") & (F.size("expected") > 0)
    hit = lambda k: asked & (F.size(F.array_except("expected", got(k))) == 0)
    some = asked & (F.col("case_type") == "multi") & F.arrays_overlap("expected", got(5))
    rows = marks.select("category", "split", "case_type", asked.alias("asked"), *[hit(k).alias(f"hit{k}") for k in (1, 3, 5)], (some & ~hit(5)).alias("part"))
    n = F.count_if("asked")
    sets = [[F.col("category")], [F.col("split")], [F.col("case_type")], [F.col(c) for c in ("category", "split", "case_type")], []]
    # A bit of grouping_id() is set where a column is summed over: category 4, split 2, case_type 1.
    level = F.element_at(F.create_map(*[F.lit(x) for x in (3, "category", 5, "split", 6, "case_type", 0, "slice", 7, "all")]), F.grouping_id().cast("int"))
    return rows.groupingSets(sets, "category", "split", "case_type").agg(
        level.alias("level"), F.count(F.lit(1)).alias("total"), n.alias("n"), F.count_if(F.col("case_type") == "abstain").alias("abstain"),
        *[percent(F.count_if(f"hit{k}"), n).alias(f"top{k}") for k in (1, 3, 5)], percent(F.count_if("part"), n).alias("partial"),
    )


def run_metrics(runs: DataFrame, by: str) -> DataFrame:
    """Verdict rates of what ran, hits of answerable cases and abstentions of the others; rows that did not run count only as such.

    runs: verdict, should_abstain, hit1, hit3, abstained.
    """
    ran = F.col("verdict") != "NOT_RUN"
    rate = lambda part, whole: percent(F.count_if(ran & part), F.count_if(ran & whole))
    told, quiet = ~F.col("should_abstain"), F.col("should_abstain")
    verdicts = [rate(F.col("verdict") == v, F.lit(True)).alias(f"{v.lower()}_rate") for v in ("PASS", "FAIL", "REVIEW", "ERROR")]
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ran).alias("not_run"), *verdicts, rate(told & F.col("hit1"), told).alias("hit_at_1"), rate(told & F.col("hit3"), told).alias("hit_at_3"),
        rate(quiet & F.col("abstained"), quiet).alias("abstain_rate"),
    )


BINS = 4096  # of a histogram that finds a quantile's neighbourhood
_RANKS = (("", "ran", 0.5), ("", "ran", 0.95), ("ok_", "good", 0.5), ("ok_", "good", 0.95))


def latency(runs: DataFrame, by: str, seconds: str = "seconds") -> DataFrame:
    """Exact median, 95th percentile and mean of all that ran, of what succeeded, and the mean of what failed.

    Quantiles are interpolated between the two values beside their rank. Two counting passes find
    them: a histogram of BINS between a group's least and largest value says in which bin a rank
    lies, and only the values of these bins are then counted one by one. What a task holds does
    not grow with a group's values, and no group is sorted as a whole.
    """
    value = F.col(seconds).cast("double")
    rows = runs.select(F.col(by).alias("_by"), F.when(F.col("verdict") != "NOT_RUN", value).alias("ran"), F.when(F.col("verdict").isin("PASS", "FAIL", "REVIEW"), value).alias("good"), F.when(F.col("verdict") == "ERROR", value).alias("failed"))
    means = rows.groupBy("_by").agg(F.avg("ran").alias("mean"), F.avg("good").alias("ok_mean"), F.avg("failed").alias("error_mean"))
    values = rows.select("_by", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("ran", "good")])).alias("x")).select("_by", "x.*").filter("v IS NOT NULL AND NOT isnan(v)")
    spans = values.groupBy("_by", "kind").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(f"{name}p{round(100 * q)}").alias("name"), F.lit(q).alias("q"), F.lit(kind).alias("of")) for name, kind, q in _RANKS])
    ranks = spans.select("_by", "kind", "least", "most", "n", F.explode(F.filter(wanted, lambda w: w["of"] == F.col("kind"))).alias("w")).select(
        "_by", "kind", "least", "most", F.col("w.name").alias("name"), (F.col("w.q") * (F.col("n") - 1)).alias("at"))
    same = lambda a, b: F.col(f"{a}._by").eqNullSafe(F.col(f"{b}._by")) & (F.col(f"{a}.kind") == F.col(f"{b}.kind"))
    bin_ = F.when(F.col("s.most") > F.col("s.least"), F.least(F.lit(BINS - 1), F.floor((F.col("v.v") - F.col("s.least")) / (F.col("s.most") - F.col("s.least")) * BINS))).otherwise(0).cast("int")
    binned = values.alias("v").join(spans.alias("s"), same("v", "s")).select("v._by", "v.kind", "v.v", bin_.alias("bin"))

    def placed(counts: DataFrame, key: str, upto: list) -> DataFrame:
        """Counts with how many values lie before each; a group has BINS rows, or those of a few bins."""
        before = Window.partitionBy(*upto).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))

    bins = placed(binned.groupBy("_by", "kind", "bin").agg(F.count(F.lit(1)).alias("c")), "bin", ["_by", "kind"])
    low, high = F.floor("r.at"), F.ceil("r.at")
    holds = (low < F.col("b.before") + F.col("b.c")) & (high >= F.col("b.before"))
    picked = bins.alias("b").join(ranks.alias("r"), same("b", "r") & holds).select("b._by", "b.kind", "b.bin", F.col("b.before").alias("before_bin"), "r.name", "r.at")
    one = picked.select("_by", "kind", "bin", "before_bin").distinct()
    in_bins = binned.alias("v").join(one.alias("p"), same("v", "p") & (F.col("v.bin") == F.col("p.bin"))).groupBy("v._by", "v.kind", "v.bin", "p.before_bin", "v.v").agg(F.count(F.lit(1)).alias("c"))
    exact = placed(in_bins, "v", ["_by", "kind", "bin"]).withColumn("before", F.col("before") + F.col("before_bin"))
    beside = exact.alias("e").join(picked.alias("r"), same("e", "r") & (F.col("e.bin") == F.col("r.bin")))
    inside = lambda at: (at >= F.col("e.before")) & (at < F.col("e.before") + F.col("e.c"))
    ends = beside.groupBy("e._by", "r.name").agg(F.max("r.at").alias("at"), F.max(F.when(inside(low), F.col("e.v"))).alias("low"), F.max(F.when(inside(high), F.col("e.v"))).alias("high"))
    found = ends.select("_by", "name", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("v"))
    wide = found.groupBy("_by").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ("p50", "p95", "ok_p50", "ok_p95")])
    out = means.alias("m").join(wide.alias("w"), F.col("m._by").eqNullSafe(F.col("w._by")), "left")
    return out.select(F.col("m._by").alias(by), "p50", "p95", "mean", "ok_p50", "ok_p95", "ok_mean", "error_mean")


def _says(text: Column, *words: str) -> Column:
    return text.rlike("|".join(words))


def dated_clauses(answer: Column) -> Column:
    """array<struct<day, of>>: the dates ('9월 9일') of an answer's clauses and what each is of: apply, consent or none."""
    apply, consent = "신청|접수", "동의|서류|가구원"

    def days(clause: Column) -> Column:
        found = F.regexp_extract_all(clause, F.lit(r"(\d{1,2}월(?U:\s*)\d{1,2}일)"), F.lit(1))
        parts = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("m"), F.regexp_extract(x, r"(\d+)일", 1).cast("int").alias("d")))
        real = F.filter(parts, lambda x: x["m"].between(1, 12) & x["d"].between(1, 31))
        return F.transform(real, lambda x: F.struct(x["m"].alias("m"), F.concat(x["m"].cast("string"), F.lit("월 "), x["d"].cast("string"), F.lit("일")).alias("day")))

    def of(clause: Column, day: Column) -> Column:
        at = F.position(F.concat(day["m"].cast("string"), F.lit("월")), clause) - 1
        start = F.greatest(at - 20, F.lit(0))
        near = clause.substr(start + 1, at + 20 - start)
        by_place = F.when((at >= 0) & near.rlike(consent) & ~near.rlike(apply), "consent").otherwise("apply")
        a, c = clause.rlike(apply), clause.rlike(consent)
        return F.when(a & c, by_place).when(a, "apply").when(c, "consent").otherwise("none")

    clauses = F.split(answer, r"(?U)[\n.;]|\s*,\s*|\s+(?:이며|이고|하지만|반면|단,)\s+")
    return F.flatten(F.transform(clauses, lambda c: F.transform(days(c), lambda d: F.struct(d["day"].alias("day"), of(c, d).alias("of")))))


def quote_ratio(answer: Column, quotes: Column) -> Column:
    """Share of quotes found: up to 4 characters literally, longer ones by at least min(2, parts) of their parts."""

    def found(quote: Column) -> Column:
        q = F.regexp_replace(quote, r"(?U)^\s+|\s+\z", "")
        parts = F.filter(F.split(q, r"(?U)[\s().~,]+"), lambda p: F.length(p) >= 2)
        held = F.size(F.filter(parts, lambda p: answer.contains(p)))
        return F.when(F.length(q) <= 4, answer.contains(q)).otherwise((F.size(parts) > 0) & (held >= F.least(F.lit(2), F.size(parts))))

    quotes = F.coalesce(quotes, F.array().cast("array<string>"))
    return F.size(F.filter(quotes, found)) / F.greatest(F.size(quotes), F.lit(1))


def answer_verdict(
    answer: Column, facts: Column, quotes: Column, negatives: Column, should_abstain: Column, category: Column, situation: Column, status: Column
) -> Column:
    """struct(status, score, reason) by the whole ordered cascade: not run, failed, abstain, bare title, missing
    information, dated categories, audience, method, then negative constraints and quotes. PASS is 1, REVIEW 0.5."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+\z", "")
    category, situation, facts = (F.coalesce(c, F.lit("")) for c in (category, situation, facts))
    give = lambda s, why: F.struct(F.lit(s).alias("status"), F.lit({"PASS": 1.0, "REVIEW": 0.5}.get(s, 0.0)).alias("score"), F.lit(why).alias("reason"))
    either = lambda good, yes, no: F.when(good, give("PASS", yes)).otherwise(give("FAIL", no))
    dates = dated_clauses(text)
    on = lambda day, of=None: F.exists(dates, lambda x: (x["day"] == day) & (F.lit(True) if of is None else x["of"] == of))
    dated, first, second = F.size(dates) > 0, "9월 9일", "9월 16일"
    negatives = F.coalesce(negatives, F.array().cast("array<string>"))
    broken = F.exists(negatives, lambda n: text.contains(n))
    literal = F.exists(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: text.contains(F.regexp_replace(q, r"(?U)^\s+|\s+\z", "")))
    ratio = quote_ratio(text, quotes)
    period = (
        F.when(on(second, "apply"), give("FAIL", "dates swapped")).when(on(first, "apply") | (on(first) & on(second, "consent")), give("PASS", "deadline given"))
        .when(~dated | _says(text, "중순", "미정", "추후"), give("REVIEW", "deadline unclear")).otherwise(give("FAIL", "other deadline"))
    )
    papers = facts.rlike("서류 ?제출")
    distinction = (
        F.when(_says(text, "마감일이 같다", "마감일은 동일", "동일합니다", "같습니다"), give("FAIL", "dates said to be equal"))
        .when(on(second, "apply") & on(first, "consent"), give("FAIL", "dates swapped"))
        .when(papers & on(second), give("PASS", "deadline of papers given")).when(papers & on(first), give("FAIL", "other deadline"))
        .otherwise(either(on(first) & on(second), "both dates given", "a date is missing"))
    )
    other_term = (
        F.when(on(first) | on(second) | on("8월 12일"), give("FAIL", "dates of another term"))
        .when(literal | on("3월 17일") | on("6월 22일") | on("9월 10일"), give("PASS", "dates of the term")).when(dated, give("FAIL", "other dates")).otherwise(give("REVIEW", "no date"))
    )
    groups = sum((text.contains(g).cast("int") for g in ("재학생", "신입생", "편입생", "재입학생", "복학생", "대학생")), F.lit(0))
    audience = F.when(broken, give("FAIL", "negative constraint broken")).when(groups >= 2, give("PASS", "audience given")).otherwise(give("REVIEW", "audience unclear"))
    ways = text.contains("한국장학재단") & _says(text, "누리집", "홈페이지", "모바일", "앱")
    method = F.when(broken, give("FAIL", "negative constraint broken")).when(ways, give("PASS", "method given")).otherwise(give("REVIEW", "method unclear"))
    denies = _says(text, "확인할 수 없습니다", "확인되지 않습니다", "찾을 수 없습니다", "본문에서 확인할 수 없")
    general = (
        F.when(broken, give("FAIL", "negative constraint broken")).when(denies & (situation != "title_only_notice") & (situation != "missing_info_in_notice"), give("FAIL", "denied needlessly"))
        .when(ratio >= 0.5, give("PASS", "quotes found")).when(ratio > 0, give("REVIEW", "some quotes found")).otherwise(give("FAIL", "no quote found"))
    )
    missing = ("확인할 수 없", "명시되어 있지", "확인되지 않", "발견되지 않", "제공되지 않", "기재되어 있지", "안내되어 있지", "공지에는 없", "정보는 없", "정보가 없")
    return (
        F.when(status == "NOT_RUN", give("NOT_RUN", "did not run")).when(status != "OK", give("ERROR", "call failed"))
        .when(F.coalesce(should_abstain, F.lit(False)) | situation.isin("irrelevant_query", "school_related_no_grounding"),
              either(_says(text, "찾지 못", "찾을 수 없", "확인할 수 없", "관련 공지", "일치하는 공지"), "abstained", "should abstain"))
        .when((situation == "title_only_notice") | (category == "title_only_notice"),
              either(_says(text, "확인할 수 없", "세부 내용", "본문에서", "원문 보기", "원문 확인", "제목만", "안내되어 있지"), "led to the page", "details of a bare title"))
        .when(category.startswith("missing_") | (situation == "missing_info_in_notice"), either(_says(text, *missing), "said to be missing", "missing information made up"))
        .when(category == "period_apply", period).when(category == "period_distinction", distinction)
        .when(category.isin("other_year_distinction", "other_semester_distinction"), other_term)
        .when(category.isin("target_audience", "freshman_rule"), audience).when(category.isin("apply_method", "apply_method_auth"), method).otherwise(general)
    )


def quota_report(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts by category, kind and split against targets, with subtotals; a group on one side only shows as well."""
    counted = items.groupBy("category", "kind", "split").agg(F.count(F.lit(1)).alias("have"))
    both = counted.join(targets, ["category", "kind", "split"], "full_outer").na.fill(0, ["have", "want"])
    return both.rollup("category", "kind", "split").agg(F.sum("have").alias("have"), F.sum("want").alias("want"), F.sum(F.greatest(F.lit(0), F.col("want") - F.col("have"))).alias("deficit"))


def review_summary(rows: DataFrame, by: str) -> DataFrame:
    """What reviewers say of answers and of their links, apart, by group.

    rows: status, has_references, answer and link (judgements; null if not yet), reasons (array,
    of what was judged wrong), retrieved and cited (whether all references were). Accuracy of
    answers is null until every case is judged, that of links until every case with references
    is; coverage counts cases with references. `failures` and `statuses` are counted by name.
    """
    referred = F.col("has_references")
    n, applicable = F.count(F.lit(1)), F.count_if(referred)
    answers, links = F.count("answer"), F.count(F.when(referred, F.col("link")))
    share = lambda c: percent(F.count_if(referred & F.coalesce(F.col(c), F.lit(False))), applicable)
    whole = rows.groupBy(by).agg(
        n.alias("cases"), answers.alias("answer_reviewed"), links.alias("link_reviewed"), F.when(answers == n, percent(F.count_if("answer"), n)).alias("answer_accuracy"),
        F.when(links == applicable, percent(F.count_if(referred & F.col("link")), applicable)).alias("link_accuracy"), share("retrieved").alias("retrieval_coverage"), share("cited").alias("citation_coverage"),
    )
    failed = ~F.coalesce("answer", F.lit(True)) | (referred & ~F.coalesce("link", F.lit(True)))
    named = rows.filter(failed).select(by, F.lit("failures").alias("kind"), F.explode(F.array_distinct("reasons")).alias("name")).unionByName(rows.select(by, F.lit("statuses").alias("kind"), F.col("status").alias("name")))
    counts = named.groupBy(F.col(by).alias("_by"), "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n")))).alias(kind)  # noqa: E731  reasons and statuses are few
    listed = counts.groupBy("_by").agg(of("failures"), of("statuses"))
    return whole.join(listed, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


REASONS = ("wrong", "incomplete", "outdated", "unsupported", "link")


def review_violations(judgments: DataFrame, cases: DataFrame) -> DataFrame:
    """case and violations of judgments that may not be counted: unknown cases, reasons that lack or are unknown, links judged without references, answers that did not run.

    judgments: case, answer, link (booleans or null), reasons, note; cases: case, has_references, status.
    """
    j = judgments.join(cases, "case", "left")
    failed = ~F.coalesce("answer", F.lit(True)) | ~F.coalesce("link", F.lit(True))
    unknown = F.size(F.array_except(F.coalesce("reasons", F.array().cast("array<string>")), F.array(*[F.lit(r) for r in REASONS]))) > 0
    checks = F.array_compact(F.array(
        F.when(F.col("status").isNull(), "unknown_case"), F.when(failed & ((F.coalesce(F.size("reasons"), F.lit(0)) <= 0) | (F.trim(F.coalesce("note", F.lit(""))) == "")), "reason_lacks"), F.when(unknown, "unknown_reason"),
        F.when(F.col("link").isNotNull() & ~F.coalesce("has_references", F.lit(False)), "link_without_references"), F.when(F.coalesce(F.col("status").isin("NOT_RUN", "ERROR"), F.lit(False)), "did_not_answer"),
    ))
    return j.select("case", checks.alias("violations")).filter(F.size("violations") > 0)


def unlike_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Why two runs may not be compared, no row if they may: fields of their contexts (one row each) that differ, and cases that one of them lacks.

    before, after: case and the context fields dataset, split, snapshot, config on every row.
    """
    fields = ("dataset", "split", "snapshot", "config")
    j = before.alias("b").join(after.alias("a"), "case", "full_outer")
    reasons = [F.when(F.col("b.dataset").isNull() | F.col("a.dataset").isNull(), "cases")] + [F.when(F.col(f"b.{f}") != F.col(f"a.{f}"), f) for f in fields]
    return j.select(F.explode(F.array_compact(F.array(*reasons))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def compare_runs(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Change of the score in percent points for cases that both runs have; unlike_runs() says whether the two may be compared."""
    j = before.select("case", by, F.col("score").alias("was")).join(after.select("case", F.col("score").alias("now")), "case")
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.round(100 * (F.avg("now") - F.avg("was")), 2).alias("delta_pp"))


def resume_plan(dataset: DataFrame, checkpoint: DataFrame, retry: str = "errors") -> DataFrame:
    """What a resumed run does with each case: reuse, retry or run. retry: none, errors or all_failed."""
    j = dataset.join(checkpoint.select("case", "verdict"), "case", "left")
    bad = {"none": F.lit(False), "errors": F.col("verdict") == "ERROR", "all_failed": F.col("verdict").isin("ERROR", "FAIL")}[retry]
    return j.withColumn("plan", F.when(F.col("verdict").isNull() | (F.col("verdict") == "NOT_RUN"), "run").when(bad, "retry").otherwise("reuse"))


def stop_after(log: DataFrame, run: str, order: list[str], stops: Column) -> DataFrame:
    """Adds not_run: whether an earlier row of the same run was a stop."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("not_run", F.coalesce(F.max(stops.cast("int")).over(w) == 1, F.lit(False)))


def verify_evidence(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Per item: reason codes of its evidence (doc, url, quote) against the documents, verdict and the ids that held."""
    e = items.select("item", F.explode_outer("evidence").alias("e")).select("item", "e.*")
    j = e.join(docs.select(F.col("id").alias("doc"), F.col("url").alias("real_url"), "title", "content"), "doc", "left")
    squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    reason = (
        F.when(F.col("doc").isNull(), "no_evidence").when(F.col("real_url").isNull(), "unknown_document").when(F.col("url") != F.col("real_url"), "other_url")
        .when(~squeeze(F.concat("title", F.lit(" "), "content")).contains(squeeze(F.col("quote"))), "quote_not_found")
    )
    g = j.withColumn("reason", reason).groupBy("item").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.array_sort(F.collect_set(F.when(F.col("reason").isNull(), F.col("doc")))).alias("checked"))
    return g.withColumn("verdict", F.when(F.size("reasons") == 0, "verified").otherwise("rejected"))


def superseded_by(docs: DataFrame) -> DataFrame:
    """id, newer (the newest correction of the same title that is later dated), n_newer (how many are) of what is no correction itself.

    docs: id, clean (the title without its marks of correction), date, corrected. Corrections are
    counted by title and day before anything is joined, and how many come later is summed over a
    title's days, so that the output is a row a document and nothing pairs up; documents meet
    their counts by title and day. Empty titles match nothing.
    """
    rows = docs.filter((F.col("clean") != "") & F.col("date").isNotNull())
    latest = F.struct(F.col("date").alias("day"), F.col("id").alias("id"))
    days = rows.groupBy("clean", "date").agg(F.count_if("corrected").alias("n"), F.max(F.when(F.col("corrected"), latest)).alias("latest"))
    later = Window.partitionBy("clean").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = days.select("clean", "date", F.sum("n").over(later).alias("n_newer"), F.max("latest").over(later)["id"].alias("newer")).filter("n_newer > 0")
    return rows.filter(~F.col("corrected")).join(above, ["clean", "date"]).select("id", "newer", "n_newer")


PER_BLOCK = 2_000  # documents of a title that meet as many corrections of it in one place


def superseding_pairs(docs: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """id, newer: what is no correction itself with every correction of the same title that is later dated; docs as in superseded_by().

    The output grows with the pairs of a title. Where a title has over per_block documents or
    corrections, both are dealt into blocks of about that many by their ids and every two blocks
    meet apart, so that the pairs of one title are made by all tasks.
    """
    spark = docs.sparkSession
    rows = stored(docs.filter(F.col("clean") != "").select("id", "clean", "date", "corrected"))  # read three times
    sizes = rows.groupBy("clean").agg(F.count_if(~F.col("corrected")).alias("n_a"), F.count_if("corrected").alias("n_b"))
    large = sizes.filter((F.greatest("n_a", "n_b") > per_block) & (F.least("n_a", "n_b") > 0))  # at most one title in per_block rows
    blocks = lambda n: F.ceil(F.col(n) / per_block).cast("int").alias(n)
    dealt = rows.join(F.broadcast(large.select("clean", blocks("n_a"), blocks("n_b"))), "clean", "left").fillna(1, ["n_a", "n_b"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    meet = lambda df: df.repartition(n, "clean", "block_a", "block_b")  # noqa: E731  # a given number: parts of few rows in make many rows out
    a = meet(dealt.filter(~F.col("corrected")).withColumns({"block_a": own("n_a"), "block_b": each("n_b")}))
    b = meet(dealt.filter("corrected").withColumns({"block_b": own("n_b"), "block_a": each("n_a")}))
    return (
        a.select("clean", "block_a", "block_b", "id", F.col("date").alias("day"))
        .join(b.select("clean", "block_a", "block_b", F.col("id").alias("newer"), "date"), ["clean", "block_a", "block_b"])
        .filter(F.col("date") > F.col("day")).select("id", "newer")
    )


def duplicates(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
