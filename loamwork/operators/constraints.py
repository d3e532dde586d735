"""Integrity constraints as queries: each gives the rows that break it, as issues of one shape."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ISSUE = ("severity", "code", "record_id", "message")


def issues(df: DataFrame, code: str, record: str | Column, message: str | Column = "", severity: str = "error") -> DataFrame:
    message = message if isinstance(message, Column) else F.lit(message)
    record = F.col(record) if isinstance(record, str) else record
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), record.cast("string").alias("record_id"), message.alias("message"))


def repeated(df: DataFrame, key: str, code: str) -> DataFrame:
    return issues(df.groupBy(key).count().where("count > 1"), code, key, F.concat(F.col("count").cast("string"), F.lit(" rows")))


def orphans(df: DataFrame, key: str, parents: DataFrame, code: str, record: str, severity: str = "error") -> DataFrame:
    return issues(df.join(parents.select(F.col(key)).distinct(), key, "left_anti"), code, record, severity=severity)


def digest_differs(df: DataFrame, text: str, digest: str, code: str, record: str) -> DataFrame:
    wrong = df.where(F.col(digest).isNull() | (F.sha2(T.filled(F.col(text)), 256) != F.col(digest)))
    return issues(wrong, code, record, F.when(F.col(digest).isNull(), "missing").otherwise("mismatch"))


def divided_groups(df: DataFrame, group: str, split: str, code: str = "group_split_leak") -> DataFrame:
    """Groups in more than one split; the excluded split doesn't count."""
    seen = df.where(F.col(split) != "excluded").groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b"))
    return issues(seen.where("a <> b"), code, group, F.concat_ws(",", "a", "b"))


def wrong_slices(parts: DataFrame, whole: DataFrame, key: str, text: str, start: str, end: str, part: str, record: str, code: str = "normalized_offset_mismatch") -> DataFrame:
    """Parts that aren't the slice of their whole that their offsets name."""
    met = parts.join(whole.select(key, F.col(text).alias("__whole")), key)
    slice_ = F.substring(F.col("__whole"), F.col(start).cast("int") + 1, (F.col(end) - F.col(start)).cast("int"))
    return issues(met.where(slice_ != F.col(part)), code, record)


def unused_or_shared(df: DataFrame, ids: str, all_ids: DataFrame, key: str, code: str = "sentence_usage") -> DataFrame:
    """Ids that aren't in exactly one of the arrays."""
    used = df.select(F.explode(ids).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    met = all_ids.select(key).join(used, key, "left").na.fill(0, ["n"])
    return issues(met.where("n <> 1"), code, key, F.concat(F.col("n").cast("string"), F.lit(" uses")))


def not_contiguous(df: DataFrame, key: str, order: str, code: str = "ordinal_gap") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    expected = F.coalesce(F.lag(order).over(w), F.lit(-1)) + 1
    return issues(df.withColumn("__e", expected).where(F.col(order) != F.col("__e")), code, key, F.concat(F.lit("expected "), F.col("__e").cast("string")))


def broken(df: DataFrame, rule: Column, code: str, record: str, severity: str = "error") -> DataFrame:
    """Rows for which a rule doesn't hold; null counts as broken."""
    return issues(df.where(~F.coalesce(rule, F.lit(False))), code, record, severity=severity)


def unresolved_glyphs(df: DataFrame, text: str, record: str) -> DataFrame:
    return issues(df.where(F.col(text).rlike(r"[\uE000-\uF8FF\uFFFD]")), "unresolved_glyph", record)


Check = Callable[[dict[str, DataFrame]], DataFrame]


def release_checks(max_tokens: int = 512, min_tokens: int = 128) -> dict[str, Check]:
    """Constraints of a release by code, over tables documents, pages, sentences, passages, inventory, split_manifest."""
    active = lambda t: t["documents"].where("status <> 'excluded'")
    return {
        "duplicate_document_id": lambda t: repeated(t["documents"], "document_id", "duplicate_document_id"),
        "duplicate_sentence_id": lambda t: repeated(t["sentences"], "sentence_id", "duplicate_sentence_id"),
        "raw_page_checksum": lambda t: digest_differs(t["pages"], "raw_text", "raw_sha256", "raw_page_checksum", "document_id"),
        "group_split_leak": lambda t: divided_groups(t["documents"], "group_id", "split"),
        "frozen_split_mismatch": lambda t: issues(
            t["documents"].alias("d").join(t["split_manifest"].alias("m"), F.col("d.document_id") == F.col("m.document_id")).where("d.split <> m.split").select("d.document_id"),
            "frozen_split_mismatch", "document_id",
        ),
        "duplicate_not_excluded": lambda t: broken(t["documents"].where("duplicate_of IS NOT NULL"), F.col("split") == "excluded", "duplicate_not_excluded", "document_id"),
        "duplicate_lineage_missing": lambda t: issues(
            t["documents"].where("duplicate_of IS NOT NULL").join(t["documents"].select(F.col("document_id").alias("duplicate_of")), "duplicate_of", "left_anti"),
            "duplicate_lineage_missing", "document_id",
        ),
        "inventory_incomplete": lambda t: orphans(t["documents"], "document_id", t["inventory"], "inventory_incomplete", "document_id"),
        "inventory_duplicate": lambda t: repeated(t["inventory"], "crawler_id", "inventory_duplicate"),
        "document_reference_missing": lambda t: orphans(t["sentences"], "document_id", t["documents"], "document_reference_missing", "sentence_id"),
        "source_page_missing": lambda t: issues(
            t["sentences"].withColumn("page_index", F.col("page_start")).join(t["pages"].select("document_id", "page_index").distinct(), ["document_id", "page_index"], "left_anti"),
            "source_page_missing", "sentence_id",
        ),
        "normalized_offset_mismatch": lambda t: wrong_slices(t["sentences"], t["documents"].withColumnRenamed("text", "body"), "document_id", "body", "doc_char_start", "doc_char_end", "text", "sentence_id"),
        "source_lineage_missing": lambda t: broken(t["sentences"], F.size("source_spans") > 0, "source_lineage_missing", "sentence_id"),
        "text_checksum": lambda t: digest_differs(t["passages"], "text", "text_sha256", "text_checksum", "passage_id"),
        "token_limit_exceeded": lambda t: broken(t["passages"], F.col("approx_tokens") <= max_tokens, "token_limit_exceeded", "passage_id"),
        "short_tail_unflagged": lambda t: broken(t["passages"], (F.col("approx_tokens") >= min_tokens) | F.col("short_tail"), "short_tail_unflagged", "passage_id"),
        "unresolved_glyph": lambda t: unresolved_glyphs(t["passages"], "text", "passage_id"),
        "review_unit_active": lambda t: broken(t["sentences"], (F.col("normalization_status") != "review_required") & (F.size("review_flags") == 0), "review_unit_active", "sentence_id"),
        "sentence_usage": lambda t: unused_or_shared(t["passages"].where("status = 'active'"), "sentence_ids", t["sentences"], "sentence_id"),
        "empty_text": lambda t: broken(active(t), F.trim("text") != "", "empty_text", "document_id"),
        "split_unknown": lambda t: broken(t["documents"], F.col("split").isin("train", "dev", "test", "excluded"), "split_unknown", "document_id"),
    }


def wrong_page_spans(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (document_id, page_index, start, end, text) that aren't the slice of their page's raw text, or have no page."""
    page = pages.select("document_id", "page_index", F.col("raw_text").alias("__raw"))
    met = lines.join(page, ["document_id", "page_index"], "left")
    bad = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.char_length("__raw"))
    slice_ = F.substring("__raw", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    record = F.concat_ws(":", "document_id", "page_index", "start")
    return issues(met.where(F.col("__raw").isNull() | bad | (slice_ != F.col("text"))), "source_span_invalid", record)


def missing_artifacts(files: DataFrame, required: DataFrame) -> DataFrame:
    """Required paths that no file has."""
    return issues(required.select("path").distinct().join(files.select("path"), "path", "left_anti"), "required_artifact_missing", "path")


def source_files_differ(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Sources (document_id, source_path, source_sha256) without digest, with an unsafe path, without a file, or changed."""
    met = documents.join(files.select(F.col("path").alias("source_path"), F.col("sha256").alias("__sha")), "source_path", "left")
    unsafe = F.startswith("source_path", F.lit("/")) | F.col("source_path").rlike(r"(?:^|[/\\\\])\.\.(?:[/\\\\]|$)")
    code = (
        F.when(F.col("source_sha256").isNull() | (F.col("source_sha256") == ""), "source_pdf_checksum_missing")
        .when(F.col("source_path").isNull() | unsafe, "source_pdf_path_unsafe")
        .when(F.col("__sha").isNull(), "source_pdf_missing")
        .when(F.col("__sha") != F.col("source_sha256"), "source_pdf_checksum_mismatch")
    )
    met = met.withColumn("__code", code).where("__code IS NOT NULL")
    return met.select(F.lit("error").alias("severity"), F.col("__code").alias("code"), F.col("document_id").cast("string").alias("record_id"), F.lit("").alias("message"))


def count_differs(counts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Declared counts (name, n) that aren't the rows of their table."""
    own = reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("__n")) for name, df in tables.items()))
    met = counts.join(own, "name", "left").where(~F.col("n").eqNullSafe(F.col("__n")))
    return issues(met, "count_mismatch", "name", F.concat_ws(" ", F.col("n").cast("string"), F.lit("declared"), F.coalesce("__n", F.lit(0)).cast("string"), F.lit("found")))


#: Fixed values of the training view.
SPLITS, TIERS, LANGUAGES = ["train", "dev", "test"], ["gold", "silver"], ["vi", "en", "mixed"]
TYPES = ["bachelor_thesis", "capstone_project", "master_thesis", "doctoral_dissertation", "research_report", "internship_report", "other"]
LABELS = {"H": 0, "P": 1, "G": 2}


def _is_true(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def training_view_checks(least_chars: int = 5000, least: int = 128, most: int = 512) -> dict[str, Check]:
    """Rules of the training view by code, over tables documents, chunks, sentences and passages."""
    eligible = lambda t: t["documents"].where(_is_true("training_eligible"))
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")

    def chunks(t: dict[str, DataFrame]) -> DataFrame:
        """Chunks with the columns of their document, named d_."""
        names = ("split", "group_id", "text", "training_eligible", "core_human_eligible")
        docs = t["documents"].select("document_id", *(F.col(c).alias(f"d_{c}") for c in names), F.lit(True).alias("d_known"))
        return t["chunks"].join(docs, "document_id", "left").withColumn("d_known", F.coalesce("d_known", F.lit(False)))

    def core_copies(t: dict[str, DataFrame]) -> DataFrame:
        core = t["chunks"].where("subset = 'core_human'").withColumn("__fp", F.sha2(T.collapsed(F.lower(T.filled(F.col("text")))), 256))
        owners = core.groupBy("__fp").agg(F.min("chunk_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
        return issues(core.join(owners, "__fp").where("chunk_id <> __first"), "duplicate_core_chunk", "chunk_id", F.col("__first"))

    slice_ = lambda a, b: F.substring("d_text", F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))
    inside = (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.char_length("d_text"))
    length = F.col("approx_tokens").between(least, most) | (_is_true("short_tail") & (F.col("approx_tokens") < least))
    known = lambda t: chunks(t).where("d_known")
    return {
        "institution_missing": lambda t: broken(t["documents"], ~empty("institution_id") & ~empty("institution_name"), "institution_missing", "document_id"),
        "eligible_metadata_missing": lambda t: broken(eligible(t), ~(empty("title") | (F.coalesce(F.size("authors"), F.lit(0)) < 1) | F.col("year").isNull() | empty("institution_id") | empty("institution_name")), "eligible_metadata_missing", "document_id"),
        "eligible_split_invalid": lambda t: broken(eligible(t), F.col("split").isin(SPLITS), "eligible_split_invalid", "document_id"),
        "eligible_quality_invalid": lambda t: broken(eligible(t), F.col("quality_tier").isin(TIERS), "eligible_quality_invalid", "document_id"),
        "eligible_too_short": lambda t: broken(eligible(t), (F.col("clean_character_count") >= least_chars) & (F.char_length("text") >= least_chars), "eligible_too_short", "document_id"),
        "language_invalid": lambda t: broken(eligible(t), F.col("language_detected").isin(LANGUAGES), "language_invalid", "document_id"),
        "document_type_invalid": lambda t: broken(t["documents"], F.col("document_type_id").isin(TYPES), "document_type_invalid", "document_id"),
        "domain_missing": lambda t: broken(t["documents"], ~empty("domain_id"), "domain_missing", "document_id"),
        "core_eligibility_invalid": lambda t: broken(t["documents"].where(_is_true("core_human_eligible")), _is_true("training_eligible") & (F.col("provenance_status") == "high_confidence_human"), "core_eligibility_invalid", "document_id"),
        "group_split_leak": lambda t: divided_groups(t["documents"], "group_id", "split"),
        "duplicate_chunk_id": lambda t: repeated(t["chunks"], "chunk_id", "duplicate_chunk_id"),
        "chunk_document_missing": lambda t: broken(chunks(t), F.col("d_known"), "chunk_document_missing", "chunk_id"),
        "chunk_split_mismatch": lambda t: broken(known(t), F.col("split").eqNullSafe(F.col("d_split")), "chunk_split_mismatch", "chunk_id"),
        "chunk_group_mismatch": lambda t: broken(known(t), F.col("group_id").eqNullSafe(F.col("d_group_id")), "chunk_group_mismatch", "chunk_id"),
        "core_provenance": lambda t: broken(known(t).where("subset = 'core_human'"), F.col("provenance_status") == "high_confidence_human", "core_provenance", "chunk_id"),
        "core_token_bound": lambda t: broken(known(t).where("subset = 'core_human'"), length, "core_token_bound", "chunk_id"),
        "duplicate_core_chunk": core_copies,
        "core_document_ineligible": lambda t: broken(known(t).where("subset = 'core_human'"), _is_true("d_core_human_eligible"), "core_document_ineligible", "chunk_id"),
        "recent_chunk_invalid": lambda t: broken(known(t).where("subset = 'recent_or_uncertain'"), _is_true("d_training_eligible") & ~F.col("provenance_status").eqNullSafe(F.lit("high_confidence_human")), "recent_chunk_invalid", "chunk_id"),
        "exclusion_reason_missing": lambda t: broken(known(t).where((F.col("subset") == "excluded") & _is_true("d_training_eligible")), ~empty("exclusion_reason"), "exclusion_reason_missing", "chunk_id"),
        "source_span_mismatch": lambda t: broken(known(t), inside & (slice_("start_char", "end_char") == F.col("text")), "source_span_mismatch", "chunk_id"),
        "crosses_sections": lambda t: broken(known(t), F.coalesce(F.size("section_ids"), F.lit(0)) <= 1, "crosses_sections", "chunk_id"),
        "mirror_count": lambda t: count_differs(t["passages"].agg(F.lit("chunks").alias("name"), F.count(F.lit(1)).alias("n")), {"chunks": t["chunks"].select("chunk_id").distinct()}),
    }


def counterfactual_checks(least_tokens: int = 30) -> dict[str, Check]:
    """Rules of counterfactual records by code, over tables records and parents (passage_id, split)."""
    text = F.trim(T.collapsed(F.col("text")))
    expected = F.coalesce(*(F.when(F.col("label_type") == k, F.lit(v)) for k, v in LABELS.items()))

    def met(t: dict[str, DataFrame]) -> DataFrame:
        parents = t["parents"].select(F.col("passage_id").alias("source_passage_id"), F.col("split").alias("h_split"), F.lit(True).alias("h_known"))
        return t["records"].join(parents, "source_passage_id", "left").withColumn("h_known", F.coalesce("h_known", F.lit(False)))

    in_order = F.forall(F.transform("sentences", lambda s, i: s["ordinal"].eqNullSafe(i)), lambda ok: ok)
    return {
        "record_id_missing": lambda t: broken(t["records"], F.col("record_id") != "", "record_id_missing", "source_passage_id"),
        "duplicate_record_id": lambda t: repeated(t["records"].where("record_id <> ''"), "record_id", "duplicate_record_id"),
        "split_mismatch": lambda t: broken(met(t).where("h_known"), F.col("split").eqNullSafe(F.col("h_split")), "split_mismatch", "record_id"),
        "parent_missing": lambda t: broken(met(t), F.col("h_known"), "parent_missing", "record_id", "warning"),
        "label_mismatch": lambda t: broken(t["records"], F.col("label_id").eqNullSafe(expected), "label_mismatch", "record_id"),
        "text_empty": lambda t: broken(t["records"], text != "", "text_empty", "record_id"),
        "short_text": lambda t: broken(t["records"], F.coalesce("approx_tokens", F.lit(0)) >= least_tokens, "short_text", "record_id", "warning"),
        "sentences_empty": lambda t: broken(t["records"], F.size("sentences") > 0, "sentences_empty", "record_id"),
        "ordinal_sequence": lambda t: broken(t["records"].where(F.size("sentences") > 0), in_order, "ordinal_sequence", "record_id"),
    }


def validate(tables: dict[str, DataFrame], checks: dict[str, Check]) -> DataFrame:
    """All issues of all checks; no rows if the tables are valid."""
    return reduce(DataFrame.unionByName, (check(tables) for check in checks.values()))
