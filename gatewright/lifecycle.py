"""Issue state of each context: matched, opened, updated and closed by runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.operators.mentions import mention_pairs
from gatewright.operators.ordered import RowBlocks, running_total
from gatewright.session import stage

# How a quality issue is recognised.
QUALITY_LABEL = "code-quality-violation"
QUALITY_TITLES = ["Code Quality Blocking Errors", "❌"]
QUALITY_BODY = "Critical Blocking Errors"
TAG = "[Branch: "
#: Mark of every issue, held by runs of a default branch; no label or tag has this form.
ALL = "\n"


def is_quality_issue() -> Column:
    test = F.array_contains("labels", QUALITY_LABEL) | F.contains(F.col("body"), F.lit(QUALITY_BODY))
    for text in QUALITY_TITLES:
        test = test | F.col("title").contains(text)
    return F.coalesce(test, F.lit(False))


def issue_keys(issues: DataFrame, tag: str = TAG) -> DataFrame:
    """(issue_id, context_key): the keys an issue names, by label or by tag.

    A tag is `[Branch: key]` in title or body. Keys hold no blank and no `[` (branch
    names cannot), but may hold `]`, so every end bracket of a run is tried. Naming
    the keys on the issue side makes the match with runs an equi join.
    """
    quality = issues.filter(is_quality_issue())
    by_label = quality.select("issue_id", F.explode("labels").alias("context_key")).filter(
        F.col("context_key") != QUALITY_LABEL
    )
    opening = tag.replace("[", r"\[")
    runs = F.regexp_extract_all(
        F.concat_ws("\n", "title", "body"), F.lit(opening + r"([^\s\[]*\])"), F.lit(1)
    )
    ends = F.split("run", r"\]")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.array_join(F.slice(ends, 1, i), "]")
    )
    by_tag = (
        quality.select("issue_id", F.explode(runs).alias("run"))
        .select("issue_id", F.explode(prefixes).alias("context_key"))
    )
    return by_label.unionByName(by_tag).distinct()


def match_issue(runs: DataFrame, issues: DataFrame, tag: str = TAG) -> DataFrame:
    """Each run with its open issue: the newest one named by label or tag, or null."""
    open_issues = issues.filter(F.col("state") == "open")
    newest = (
        issue_keys(open_issues, tag).join(open_issues.select("issue_id", "opened_at"), "issue_id")
        .groupBy("context_key")
        .agg(F.max_by("issue_id", F.struct("opened_at", "issue_id")).alias("issue_id"))
    )
    return runs.join(newest, "context_key", "left")


def context_forms(pr: Column, branch: Column) -> tuple[Column, Column]:
    """(label, tag) of a run: of its pull request, else of its branch, else null."""
    has_branch = F.coalesce(branch, F.lit("")) != ""
    return (
        F.when(pr.isNotNull(), F.concat(F.lit("pr-"), pr.cast("string"))).when(has_branch, F.concat(F.lit("branch-"), branch)),
        F.when(pr.isNotNull(), F.format_string("[PR #%s]", pr.cast("string"))).when(has_branch, F.format_string("[Branch: %s]", branch)),
    )


def marks_of(labels: Column, text: Column) -> Column:
    """Labels, and tags in a text, as one array.

    A branch may hold `]`, so each end bracket of a run without blanks and `[` ends a tag.
    """
    def tags(run: Column) -> Column:
        ends = F.split(run, r"\]")
        return F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.concat(F.array_join(F.slice(ends, 1, i), "]"), F.lit("]")))

    runs = F.regexp_extract_all(text, F.lit(r"(\[(?:PR #|Branch: )[^\s\[]*\])"), F.lit(1))
    return F.concat(F.coalesce(labels, F.array().cast("array<string>")), F.flatten(F.transform(runs, tags)))


def issue_marks(issues: DataFrame) -> DataFrame:
    """(issue_id, mark): labels of quality issues, and tags in their title or body."""
    marks = marks_of(F.col("labels"), F.concat_ws("\n", "title", "body"))
    return issues.filter(is_quality_issue()).select("issue_id", F.explode(marks).alias("mark")).distinct()


def match_context(runs: DataFrame, issues: DataFrame, label: str = "label", tag: str = "tag") -> DataFrame:
    """Each run with the newest open quality issue that has its label or holds its tag, or null."""
    open_issues = issues.filter(F.col("state") == "open")
    newest = issue_marks(open_issues).join(open_issues.select("issue_id", "opened_at"), "issue_id").groupBy("mark").agg(
        F.max(F.struct("opened_at", "issue_id")).alias("found"))
    by = lambda column, out: newest.select(F.col("mark").alias(column), F.col("found").alias(out))
    met = runs.join(by(label, "__label"), label, "left").join(by(tag, "__tag"), tag, "left")
    return met.withColumn("issue_id", F.greatest("__label", "__tag")["issue_id"]).drop("__label", "__tag")


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows replace current rows of the same key; others are kept.

    Both sides hold at most one row per key. Columns the incoming side lacks keep
    their current value. `action` says what happened: inserted, updated or kept.
    """
    cur, inc = current.alias("cur"), incoming.alias("inc")
    names = [c for c in current.columns if c not in key]
    on = [F.col(f"cur.{k}") == F.col(f"inc.{k}") for k in key]
    has_cur, has_inc = F.col(f"cur.{key[0]}").isNotNull(), F.col(f"inc.{key[0]}").isNotNull()
    return cur.join(inc, on, "full_outer").select(
        *[F.coalesce(f"inc.{k}", f"cur.{k}").alias(k) for k in key],
        *[
            (F.when(has_inc, F.col(f"inc.{c}")).otherwise(F.col(f"cur.{c}")) if c in incoming.columns
             else F.col(f"cur.{c}")).alias(c)
            for c in names
        ],
        F.when(has_cur & has_inc, "updated").when(has_inc, "inserted").otherwise("kept").alias("action"),
    )


def lifecycle(results: DataFrame, keys: Sequence[str], ts: str, tie: str, failed: Column, target_rows: int = 1_000_000) -> DataFrame:
    """Issues of each key: opened by the first failure, updated by more, closed by a pass.

    A key's time line is cut by its passes; the failures between two passes are one
    issue and the pass that ends it closes it. A row whose `failed` is null passes; rows
    without a key belong to no context and are left out. Keys with more
    than `target_rows` rows are worked on in blocks.
    """
    prepared = results.select(
        *keys, F.col(ts).alias("__ts"), F.col(tie).alias("__tie"), F.coalesce(failed, F.lit(False)).alias("__fail"),
    ).dropna(subset=list(keys))
    cut = running_total(
        prepared, keys, ["__ts", "__tie"], RowBlocks(target_rows),
        F.when(F.col("__fail"), 0).otherwise(1), "__island", inclusive=False,
    )
    fail = F.col("__fail")
    return (
        cut.groupBy(*keys, "__island")
        .agg(
            F.min(F.when(fail, F.col("__ts"))).alias("opened_at"),
            F.max(F.when(fail, F.col("__ts"))).alias("updated_at"),
            F.min(F.when(~fail, F.col("__ts"))).alias("closed_at"),
            F.count_if(fail).alias("failures"),
        )
        .filter("failures > 0")
        .withColumn("state", F.when(F.col("closed_at").isNull(), "open").otherwise("closed"))
        .drop("__island")
    )


def close_scope(runs: DataFrame, issues: DataFrame, files: DataFrame, default_keys: Sequence[str] = ("main", "master"),
                suffix: str = ".cs", label: Column | None = None, tag: Column | None = None) -> DataFrame:
    """Open issues closed by passing runs: (issue_id, closed_at, closed_by).

    A passing run closes the issues that have its label or hold its tag, and those mentioning
    a file it touched; one on a default branch closes all. Runs are
    (run_id, context_key, ts, passed), files (run_id, path). `label` and `tag` are columns of runs, as
    `context_forms` gives them; without them the context key is the label and `[Branch: key]` the tag.
    Each issue is closed by the earliest such run.
    """
    key = F.col("context_key")
    label = key if label is None else label
    tag = F.concat(F.lit(TAG), key, F.lit("]")) if tag is None else tag
    closer = F.struct("ts", "run_id")
    passing = runs.filter("passed").withColumn("closer", closer)
    # What closes: labels, tags and the default branch, which stands for every issue, as marks of one table; then names of files.
    everything = F.when(key.isin(list(default_keys)), F.lit(ALL))
    marked = passing.select("closer", F.explode(F.array_compact(F.array(label, tag, everything))).alias("mark")).filter(F.col("mark") != QUALITY_LABEL)
    closers = marked.groupBy("mark").agg(F.min("closer").alias("closer"))
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    by_name = stage(
        files.withColumn("name", name).filter(F.col("name").endswith(suffix))
        .join(passing.select("run_id", "closer"), "run_id").groupBy("name").agg(F.min("closer").alias("closer")), "names")

    text = F.concat_ws("\n", "title", "body")
    quality = stage(issues.filter((F.col("state") == "open") & is_quality_issue()).select(
        "issue_id", text.alias("text"), F.array_distinct(F.concat(marks_of(F.col("labels"), text), F.array(F.lit(ALL)))).alias("marks")), "open-issues")
    by_mark = quality.select("issue_id", F.explode("marks").alias("mark")).join(closers, "mark").select("issue_id", "closer")
    by_file = mention_pairs(quality, "issue_id", "text", by_name, "name").join(
        by_name, F.col("needle") == F.col("name")).select("issue_id", "closer")
    return (
        by_mark.unionByName(by_file)
        .groupBy("issue_id").agg(F.min("closer").alias("closer"))
        .select("issue_id", F.col("closer.ts").alias("closed_at"), F.col("closer.run_id").alias("closed_by"))
    )
