"""The whole verification of finished jobs: every family of rules together, and a record for each job that keeps them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.session import by_shuffle, cut_jobs

from .contracts import broken, union, validate
from .diff import content_diff, geometry_diff
from .evidence import CANDIDATE, final_rules, render_rules, review_rules, verification

#: Families in the order in which a sequential check meets them.
FAMILIES = ("documents", "final", "mapping", "content", "geometry", "review", "render")


def review_images(reviews: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, name, role, sha256): the pictures of the source and of the candidate that reviews name, sheets and dense regions alike."""
    both = lambda x: F.array(*(F.struct(x[f"{role}Image"].alias("name"), F.lit(role).alias("role")) for role in ("source", "candidate")))
    sheets = reviews.select("job_id", F.explode("sheets").alias("s"))
    named = sheets.select("job_id", F.explode(F.concat(both(F.col("s")), F.flatten(F.transform(F.coalesce("s.denseRegions", F.array()), both)))).alias("i"))
    return named.select("job_id", "i.name", "i.role").distinct().join(files.select("job_id", "name", "sha256"), ["job_id", "name"], "left")


def verify(
    tasks: DataFrame, source: DataFrame, mapping: DataFrame, saved: DataFrame, receipts: DataFrame, reviews: DataFrame, files: DataFrame, renders: DataFrame, originals: DataFrame, folders: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Violations (job_id, family, rule_ord, rule, key, detail) of all jobs in tasks, and the records of those without any.

    Documents have one row for each job. files: (job_id, name, sha256, is_png), names relative to the job's folder; renders: (job_id, name,
    drawingSha256, pngSha256, native), name that of the image; originals: (job_id, sha256), of the drawing as it is now; folders:
    (job_id, folder). A job that lacks a document breaks DOC1 for each; documents of jobs without a task count for nothing.
    """
    documents = {"source": source, "mapping": mapping, "saved": saved, "receipt": receipts, "review": reviews}
    jobs = tasks.select("job_id").distinct()
    with by_shuffle(tasks.sparkSession):  # written, as every family reads them
        known = {name: cut_jobs(d.join(jobs, "job_id", "left_semi")) for name, d in documents.items()}
    have = jobs
    for name, d in known.items():
        have = have.join(d.select("job_id", F.lit(True).alias(f"has_{name}")).distinct(), "job_id", "left")
    source, mapping, saved, receipts, reviews = known.values()
    files = files.join(jobs, "job_id", "left_semi")
    candidates = files.where(F.col("name") == CANDIDATE).select("job_id", F.col("sha256").alias("candidateSha256"))
    families = {
        "documents": union([broken(have, 1, "DOC1", F.col(f"has_{name}"), F.lit(name), "document is missing") for name in documents]),
        "final": final_rules(tasks, mapping, receipts, source, saved, files, originals, folders),
        "mapping": validate(source, mapping),
        "content": content_diff(source, mapping, saved, receipts),
        "geometry": geometry_diff(source, saved, mapping),
        "review": review_rules(reviews, tasks, candidates, mapping, files),
        "render": render_rules(review_images(reviews, files), renders, tasks, candidates),
    }
    found = reduce(DataFrame.unionByName, (families[f].select("job_id", F.lit(f).alias("family"), "rule_ord", "rule", "key", "detail") for f in FAMILIES))
    with by_shuffle(tasks.sparkSession):
        return found, cut_jobs(verification(tasks, candidates, reviews, files, found))


def first_failures(violations: DataFrame) -> DataFrame:
    """The violation of each job that a sequential check meets first: by family, then by rule and key."""
    rank = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    best = violations.groupBy("job_id").agg(F.min_by(F.struct("family", "rule", "key", "detail"), F.struct(rank, "rule_ord", "key")).alias("v"))
    return best.select("job_id", "v.*")
