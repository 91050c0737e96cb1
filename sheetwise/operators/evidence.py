"""Evidence of a finished job: hashes that must agree, reviews that must be complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import text

from .contracts import broken, union


def review_rules(reviews: DataFrame, tasks: DataFrame, candidates: DataFrame, mappings: DataFrame, files: DataFrame) -> DataFrame:
    """Violations of visual reviews. files: (job_id, name, sha256, is_png), names relative to the job's folder.

    A review must name the task's source and the candidate (job_id, candidateSha256), and state that no issue is open: a missing
    list of issues is no empty one. Sheets must be those of the mapping's scope, each reviewed with dense regions, and every image a PNG of the job.
    """
    scope = mappings.select("job_id", F.explode("scope.sheetIds").alias("id"))
    sheets = reviews.select("job_id", F.explode("sheets").alias("s")).select("job_id", "s.*")
    bound = reviews.join(tasks.select("job_id", F.col("sourceSha256").alias("t_source")), "job_id", "left").join(candidates.select("job_id", F.col("candidateSha256").alias("c_candidate")), "job_id", "left")
    named = (F.col("sourceSha256") == F.col("t_source")) & (F.col("candidateSha256") == F.col("c_candidate"))
    # scope and sheets are grouped once for three rules; a null id has no counterpart
    both = scope.select("job_id", "id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(sheets.select("job_id", "id", F.lit(0), F.lit(1))).groupBy("job_id", "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    known = F.col("job_id").isNotNull() & F.col("id").isNotNull()
    dense = F.flatten(F.transform("denseRegions", lambda d: F.array(d["sourceImage"], d["candidateImage"])))
    images = sheets.select("job_id", "id", F.explode(F.concat(F.array("sourceImage", "candidateImage"), F.coalesce(dense, F.array().cast("array<string>")))).alias("name"))
    seen = images.join(files.select("job_id", "name", "is_png"), ["job_id", "name"], "left")
    return union([
        broken(bound, 1, "RV1", named, "job_id", "review of another source or candidate"),
        broken(reviews, 2, "RV2", F.col("issues").isNotNull() & (F.size("issues") == 0) & F.col("translationReviewed") & F.col("symbolsReviewed"), "job_id", "issues or unfinished review"),
        broken(reviews, 3, "RV3", F.size("sheets") > 0, "job_id", "no sheets"),
        broken(both, 3, "RV3", F.col("b") <= 1, "id", "sheet repeats"),
        broken(both, 4, "RV4", (F.col("a") == 0) | (F.col("b") > 0) & known, "id", "sheets are not the scope"),
        broken(both, 4, "RV4", (F.col("b") == 0) | (F.col("a") > 0) & known, "id", "sheets are not the scope"),
        broken(sheets, 5, "RV5", F.col("reviewed") & (F.size("denseRegions") > 0), "id", "sheet not reviewed with dense regions"),
        broken(seen, 6, "RV6", F.col("is_png").isNotNull(), F.concat_ws(" ", "id", "name"), "image is missing"),
        broken(seen, 7, "RV7", F.coalesce("is_png", F.lit(True)), F.concat_ws(" ", "id", "name"), "not a PNG image"),
    ])


def render_rules(images: DataFrame, renders: DataFrame, tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Violations of RV8: an image's render receipt must be native and name the image's hash and that of the drawing it shows.

    images: (job_id, name, role source or candidate, sha256); renders: (job_id, name, drawingSha256, pngSha256, native), name that
    of the image; candidates: (job_id, candidateSha256).
    """
    got = images.join(renders.withColumn("there", F.lit(1)), ["job_id", "name"], "left").join(tasks.select("job_id", "sourceSha256"), "job_id", "left").join(candidates, "job_id", "left")
    drawing = F.when(F.col("role") == "source", F.col("sourceSha256")).otherwise(F.col("candidateSha256"))
    return union([broken(got, 8, "RV8", (F.col("there") == 1) & F.col("native") & (F.col("pngSha256") == F.col("sha256")) & (F.col("drawingSha256") == drawing), F.concat_ws(" ", "role", "name"), "image is not bound to its drawing")])


# The documents that a verification binds by hash, and the field of each.
BOUND = {"mapping.json": "mappingSha256", "saved/extracted.json": "savedSnapshotSha256", "visual-review.json": "visualReviewSha256", "write-status.json": "writeStatusSha256"}


def verification(tasks: DataFrame, candidates: DataFrame, reviews: DataFrame, files: DataFrame, violations: DataFrame) -> DataFrame:
    """One record for each job without a violation: status, hashes of source, candidate and the bound documents, sheets and warnings.

    files: (job_id, name, sha256), names relative to the job's folder.
    """
    hashes = files.groupBy("job_id").agg(*(F.max(F.when(F.col("name") == n, F.col("sha256"))).alias(c) for n, c in BOUND.items()))
    sound = tasks.join(violations.select("job_id").distinct(), "job_id", "left_anti").join(candidates, "job_id").join(hashes, "job_id")
    sound = sound.join(reviews.select("job_id", F.transform("sheets", lambda x: x["id"]).alias("reviewedSheetIds"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")), "job_id")
    return sound.select("job_id", F.lit("verified").alias("status"), "mode", "sourceSha256", "candidateSha256", "reviewedSheetIds", "warnings", *BOUND.values())


def delivery_rules(verified: DataFrame, files: DataFrame, sources: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Violations of FN7: a delivery needs a verified record whose hashes are still those of the candidate, the source, the bound documents and the final copy.

    files: (job_id, name, sha256) with candidate.dwg; sources and copies: (job_id, sha256).
    """
    now = files.groupBy("job_id").agg(*(F.max(F.when(F.col("name") == n, F.col("sha256"))).alias(f"now_{c}") for n, c in (*BOUND.items(), ("candidate.dwg", "candidateSha256"))))
    seen = verified.join(now, "job_id", "left").join(sources.select("job_id", F.col("sha256").alias("now_sourceSha256")), "job_id", "left")
    rules = [broken(seen, 7, "FN7", F.col("status") == "verified", "job_id", "not verified")]
    rules += [broken(seen, 7, "FN7", F.col(c) == F.col(f"now_{c}"), "job_id", f"{c} changed") for c in ("candidateSha256", "sourceSha256", *BOUND.values())]
    if copies is not None:
        final = verified.select("job_id", "candidateSha256").join(copies, "job_id", "left")
        rules.append(broken(final, 7, "FN7", F.col("sha256") == F.col("candidateSha256"), "job_id", "final copy"))
    return union(rules)


# The drawing that is delivered, and the separate copy that a verification opens.
CANDIDATE, SEPARATE = "candidate.dwg", "saved/input.dwg"


def final_rules(tasks: DataFrame, mappings: DataFrame, receipts: DataFrame, source: DataFrame, saved: DataFrame, files: DataFrame, originals: DataFrame, folders: DataFrame) -> DataFrame:
    """Violations that forbid a delivery: source, candidate and saved hashes, mode, languages, receipt and sheets.

    files: (job_id, name, sha256), names relative to the job's folder, candidate.dwg among them; originals: (job_id, sha256), of the
    drawing that the task names as it is now; folders: (job_id, folder), absolute. The saved snapshot must come from the job's own separate
    copy of the candidate; paths are compared by their steps, `.` and `..` resolved, links not. A receipt must state an empty list of errors.
    """
    pick = lambda df, s, *cols: df.select("job_id", *(F.col(c).alias(f"{s}_{c}") for c in cols))
    all_ = tasks.join(pick(mappings, "m", "mode", "sourceLanguage", "targetLanguage", "scope"), "job_id", "left")
    all_ = all_.join(pick(receipts, "r", "schemaVersion", "status", "errors", "candidateSha256"), "job_id", "left")
    all_ = all_.join(pick(source, "x", "sourceSha256"), "job_id", "left").join(pick(originals, "o", "sha256"), "job_id", "left").join(pick(folders, "d", "folder"), "job_id", "left")
    all_ = all_.join(pick(saved, "v", "openedCandidateSha256", "cadInputSha256", "engine"), "job_id", "left")
    now = files.where(F.col("name").isin(CANDIDATE, SEPARATE)).groupBy("job_id").agg(*(F.max(F.when(F.col("name") == n, F.col("sha256"))).alias(c) for n, c in ((CANDIDATE, "f_sha256"), (SEPARATE, "s_sha256"))))
    all_ = all_.join(now, "job_id", "left")
    apart = text.path_steps(F.col("v_engine.inputPath")) == text.path_steps(F.concat("d_folder", F.lit(f"/{SEPARATE}")))
    ids = F.col("m_scope.sheetIds")
    no_errors = F.col("r_errors").isNotNull() & (F.size("r_errors") == 0)
    return union([
        broken(all_, 1, "FN1", (F.col("sourceSha256") == F.col("o_sha256")) & (F.col("sourceSha256") == F.col("x_sourceSha256")), "job_id", "source hash"),
        broken(all_, 2, "FN2", (F.col("mode") == F.col("m_mode")) & (F.col("sourceLanguage") == F.col("m_sourceLanguage")) & (F.col("targetLanguage") == F.col("m_targetLanguage")), "job_id", "mode or languages"),
        broken(all_, 3, "FN3", (F.col("r_schemaVersion") == 1) & no_errors & (F.col("r_status") == "written-awaiting-verification"), "job_id", "receipt"),
        broken(all_, 3, "FN3", F.col("f_sha256") == F.col("r_candidateSha256"), "job_id", "candidate changed or is missing"),
        broken(all_, 4, "FN4", F.col("v_openedCandidateSha256") == F.col("f_sha256"), "job_id", "another file was opened"),
        broken(all_, 5, "FN5", apart & (F.col("s_sha256") == F.col("v_cadInputSha256")), "job_id", "the separate copy was not opened"),
        broken(all_, 6, "FN6", (F.size(ids) > 0) & (F.size(ids) == F.size(F.array_distinct(ids))), "job_id", "sheet ids"),
    ])
