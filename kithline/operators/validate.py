"""Checks of result files, line by line on raw text: quotes mean nothing here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.functions import text as T

MATCHING, CANDIDATES = ["source1_entity_id", "matched_entity_ids"], ["source1_entity_id", "candidate_entity_ids"]
FINDINGS = "severity string, rule string, offenders bigint, examples string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and number (from 0) of each line; a file is read whole and in order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("number", "value"))


def parsed(raw: DataFrame) -> DataFrame:
    """s1, ids (array), tab (whether the line has one) of the lines after the first; lines without text or tab are left out."""
    rows = raw.where("number > 0").select("number", "value", F.expr("instr(value, '\t') > 0").alias("tab"), F.expr("split(value, '\t', 2)").alias("p"))
    ids = F.expr(f"if(not tab or trim(p[1]) = '', {T.EMPTY}, split(p[1], ','))")
    return rows.select("number", "value", "tab", F.col("p")[0].alias("s1"), ids.alias("ids")).where("tab or trim(value) <> ''")


def header_findings(raw: DataFrame, expected: list[str]) -> list[tuple[str, str, int, str]]:
    first = raw.where("number = 0").first()
    if first is None or first["value"] == "" and raw.limit(2).count() == 1:
        return [("error", "empty file", 1, "")]
    got = first["value"]
    if "\t" not in got and "," in got:
        return [("error", "comma-separated header", 1, got)]
    if [c.strip().lower() for c in got.split("\t")] != expected:
        return [("error", "unexpected header", 1, got)]
    return []


def examples(rows: DataFrame, column: str, severity: str, rule: str) -> DataFrame:
    """One finding: how many different offenders, the first five of them; nothing if there are none."""
    few = rows.select(F.col(column).alias("x")).distinct()
    return few.groupBy().agg(F.count("*").alias("offenders")).where("offenders > 0").crossJoin(few.orderBy("x").limit(5).agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("examples"))).select(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "offenders", "examples"
    )


def content_findings(rows: DataFrame, required: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Findings about parsed rows. required: s1. targets: id of all records that may be matched, to check ids against."""
    good = rows.where("tab")
    ids = good.select("s1", F.explode("ids").alias("id"))
    out = [
        examples(rows.where("not tab"), "value", "error", "no tab"),
        examples(good.groupBy("s1").count().where("count > 1"), "s1", "error", "duplicate rows"),
        examples(good.where("size(ids) <> size(array_distinct(ids))"), "s1", "error", "duplicate ids in a list"),
        examples(ids.where("id like 'S1-%'"), "id", "error", "source 1 ids in a list"),
        examples(ids.where("not id like 'S1-%' and not id like 'S2-%' and not id like 'S3-%'"), "id", "error", "ids without a known prefix"),
        examples(required.select("s1").distinct().join(good, "s1", "left_anti"), "s1", "error", "required rows missing"),
        examples(good.select("s1").distinct().join(required, "s1", "left_anti"), "s1", "error", "rows not asked for"),
    ]
    if targets is not None:
        out.append(examples(ids.where("id like 'S2-%' or id like 'S3-%'").join(targets.select("id"), "id", "left_anti"), "id", "error", "unknown ids"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def subset_findings(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that aren't among the candidates: a warning."""
    pairs = lambda rows: rows.where("tab").select("s1", F.explode("ids").alias("id")).distinct()
    return examples(pairs(matches).join(pairs(candidates), ["s1", "id"], "left_anti").select(F.concat_ws(":", "s1", "id").alias("pair")), "pair", "warning", "matches not in candidates")


def validate(spark: SparkSession, matching: str, required: DataFrame, candidates: str | None = None, targets: DataFrame | None = None) -> list[tuple[str, str, int, str]]:
    """All findings about the files; no error among them means they pass."""
    found: list[tuple[str, str, int, str]] = []
    parts = {}
    for path, expected in ((matching, MATCHING), (candidates, CANDIDATES)):
        if path is None:
            found.append(("warning", "no candidate file", 1, ""))
            continue
        try:
            raw = lines(spark, path)
            head = header_findings(raw, expected)
        except Exception as e:  # the reader says what is wrong with the path
            if "PATH_NOT_FOUND" not in str(e):
                raise
            head = [("error", "file not found", 1, path)]
        found += head
        if not head:
            parts[path] = parsed(raw)
            found += [tuple(r) for r in content_findings(parts[path], required, targets).collect()]
    if targets is None:
        found.append(("warning", "ids not checked", 1, ""))
    if candidates in parts and matching in parts:
        found += [tuple(r) for r in subset_findings(parts[matching], parts[candidates]).collect()]
    return found


def passes(findings: list[tuple[str, str, int, str]]) -> bool:
    return all(severity != "error" for severity, *_ in findings)


def main(args: list[str]) -> int:
    """matching.tsv required.tsv [candidates.tsv]: prints findings; 0 if the files pass."""
    spark = SparkSession.builder.getOrCreate()
    required = parsed(lines(spark, args[1])).select("s1")
    found = validate(spark, args[0], required, args[2] if len(args) > 2 else None)
    for severity, rule, n, shown in found:
        print(f"{severity.upper()}: {rule}: {n} total, e.g. {shown}")
    print("PASS" if passes(found) else "FAIL")
    return int(not passes(found))
