"""Clinical notes, observations and record clusters to one schema: cleaning, lookups, summaries and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.retrieval import STOPWORDS, dealt

NOTE_COLUMNS = ["patient_id", "note_id", "note_type", "specialty", "age", "gender", "primary_diagnosis", "diagnosis", "text", "keywords"]

# Ordered keyword rules of report labels; the first that holds any of its words gives the label.
REPORT_RULES = [
    ("cxr_pneumonia", ["pneumonia", "consolidation"]),
    ("cxr_effusion", ["effusion", "pleural"]),
    ("cxr_pneumothorax", ["pneumothorax"]),
    ("cxr_cardiac", ["cardiomegaly", "heart failure", "vascular congestion"]),
    ("cxr_fracture", ["fracture"]),
    ("cxr_no_acute", ["no acute", "no evidence", "no significant", "normal", "unremarkable"]),
]
# The chapters of numeric diagnosis codes.
ICD9_CHAPTERS = [
    (1, 139, "icd9_infectious"),
    (140, 239, "icd9_neoplasms"),
    (240, 279, "icd9_endocrine_nutritional"),
    (280, 289, "icd9_blood"),
    (290, 319, "icd9_mental"),
    (320, 389, "icd9_nervous_sense"),
    (390, 459, "icd9_circulatory"),
    (460, 519, "icd9_respiratory"),
    (520, 579, "icd9_digestive"),
    (580, 629, "icd9_genitourinary"),
    (630, 679, "icd9_pregnancy"),
    (680, 709, "icd9_skin"),
    (710, 739, "icd9_musculoskeletal"),
    (740, 759, "icd9_congenital"),
    (760, 779, "icd9_perinatal"),
    (780, 799, "icd9_symptoms_signs"),
    (800, 999, "icd9_injury_poisoning"),
]


def cleaned(text: Column) -> Column:
    """Without ``[** … **]`` masks, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[\*\*.*?\*\*\]", ""), r"\s+", " "))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def first_per_key(frame: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """key and the values of its first row, by one aggregation."""
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("v")
    return frame.groupBy(key).agg(first).select(key, *(F.col(f"v.{v}").alias(v) for v in values))


def last_per_key(frame: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return frame.groupBy(key).agg(last).select(key, *(F.col(f"v.{v}").alias(v) for v in values))


def top_per_key(frame: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return frame.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def listed_per_key(frame: DataFrame, key: str, order: list[Column], k: int, item: Column, name: str, sep: str = "; ") -> DataFrame:
    """key and one text of its first k items in order."""
    top = top_per_key(frame.withColumn("__item", item), key, order, k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "__item"))), lambda x: x["__item"]), sep)
    return top.groupBy(key).agg(joined.alias(name))


def summary_text(parts: list[DataFrame], key: str, labels: dict[str, str]) -> DataFrame:
    """key, text: the labelled parts of every key that any table has, joined by `` | ``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full")
    filled = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in labels.items()]
    return out.select(key, F.concat_ws(" | ", *filled).alias("text"))


def looked_up(frame: DataFrame, dimension: DataFrame, key: str, label: str, default: str) -> DataFrame:
    """Left equi-join to a dimension; missing or blank labels take the default. The optimizer picks broadcast by size."""
    return frame.join(dimension.select(key, label), key, "left").withColumn(label, F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit(default)))


def icd_chapter(code: Column) -> Column:
    """Chapter of a diagnosis code by what stands before its dot: V and E codes, tenth-revision letters, numeric ranges; else unknown."""
    whole = F.element_at(F.split(F.upper(F.trim(F.coalesce(code, F.lit("")))), r"\."), 1)
    number = F.substring(F.regexp_replace(whole, "[^0-9]", ""), 1, 3).try_cast("int")
    out = F.when(whole.rlike("^V[0-9]+$"), F.lit("icd9_supplemental")).when(whole.rlike("^E[0-9]+$"), F.lit("icd9_external"))
    out = out.when(whole.rlike("^[A-Z][0-9]"), F.concat(F.lit("icd10_chapter_"), F.substring(whole, 1, 1))).when(whole.rlike(r"^\p{L}"), F.lit("unknown"))
    for low, high, name in ICD9_CHAPTERS:
        out = out.when(number.between(low, high), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def report_class(text: Column) -> Column:
    """Label of the first keyword rule that the text meets; abnormal without any, unknown for blank texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for label, words in REPORT_RULES:
        held = F.lit(False)
        for word in words:
            held = held | low.contains(word)
        out = out.when(held, F.lit(label))
    return out.when(low.rlike(r"\S"), F.lit("cxr_abnormal")).otherwise(F.lit("cxr_unknown"))


def positive_labels(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, diagnosis: comma-joined names of columns whose value is positive, else no_finding."""
    hits = F.filter(F.array(*(F.when(F.trim(F.col(c)).isin("1", "1.0", "yes", "Y"), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return wide.select(key, F.when(F.size(hits) > 0, F.array_join(hits, ",")).otherwise(F.lit("no_finding")).alias("diagnosis"))


def message_text(messages: Column) -> Column:
    """The assistant's turns of an array of (role, content), joined by line breaks."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: m["content"]), "\n")


def notes(frame: DataFrame, source: str, columns: dict[str, Column], least_chars: int = 30) -> DataFrame:
    """Rows in the note schema: missing fields are null, texts cleaned, and short texts dropped."""
    made = frame.select(*(columns[c].alias(c) if c in columns else F.lit(None).cast("int" if c == "age" else "string").alias(c) for c in NOTE_COLUMNS))
    return made.withColumn("text", cleaned(F.col("text"))).where(F.length("text") >= least_chars).withColumn("source", F.lit(source))


def keep_first(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    ranked = frame.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__k = 1").drop("__k")


def age_of(text: Column) -> Column:
    """``> 89`` counts as 90; what isn't a number is null."""
    return F.when(F.trim(text).rlike("^>\\s*89$"), F.lit(90)).otherwise(F.trim(text).try_cast("int"))


def last_segment(text: Column, sep: str = "|") -> Column:
    return F.trim(F.element_at(F.split(text, "\\" + sep), -1))


def recording_ids(path: Column) -> dict[str, Column]:
    """Patient and stay of a recording's path, digits only."""
    parts = F.split(path, "/")
    return {"patient_id": F.regexp_replace(F.get(parts, F.size(parts) - 2), r"\D", ""), "stay_id": F.regexp_replace(F.element_at(parts, -1), r"\D", "")}


def observations(points: DataFrame, target: str, instrument: str, wavelength: str, depth: str, upper: str, lower: str, least_points: int = 3) -> DataFrame:
    """target, instrument, step, wavelengths, depths, uncertainties of each instrument with enough valid points.

    Values that aren't numbers are dropped, errors are the mean of both sides, parts per million become
    fractions where the median depth exceeds 0.1, and steps number a target's instruments by name.
    """
    number = lambda c: F.col(c).try_cast("double")
    rows = points.select(target, instrument, number(wavelength).alias("w"), number(depth).alias("d"), ((F.abs(number(upper)) + F.abs(number(lower))) / 2).alias("u")).where("w > 0 and d is not null and u is not null")
    held = rows.groupBy(target, instrument).agg(F.array_sort(F.collect_list(F.struct("w", "d", "u"))).alias("p"), F.percentile("d", F.lit(0.5)).alias("m")).where(F.size("p") >= least_points)
    scale = F.when(F.col("m") > 0.1, F.lit(1e-6)).otherwise(F.lit(1.0))
    step = F.row_number().over(Window.partitionBy(target).orderBy(instrument)) - 1
    return held.select(target, instrument, step.cast("long").alias("step"), F.transform("p", lambda x: x["w"]).alias("wavelengths"), F.transform("p", lambda x: x["d"] * scale).alias("depths"), F.transform("p", lambda x: x["u"] * scale).alias("uncertainties"))


def top_terms(frame: DataFrame, key: str, text: Column, k: int, most_tokens: int | None = None, pattern: str = "[a-z]{4,}") -> DataFrame:
    """key, term, n, place: the k most frequent content terms, ties by first place in the text."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    if most_tokens:
        tokens = F.slice(tokens, 1, most_tokens)
    # texts are tokenised before their only exchange; what follows is grouped by key alone
    parts = dealt(frame.select(key, F.array_join(tokens, " ").alias("words")), frame, key)
    placed = parts.select(key, F.posexplode(F.split("words", " ")).alias("p", "term")).where((F.col("term") != "") & ~F.col("term").isin(STOPWORDS))
    counted = placed.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    return top_per_key(counted, key, [F.desc("n"), F.asc("first"), F.asc("term")], k).drop("first")


def record_clusters(rows: DataFrame, group: str, text: str, order: str, examples: int = 2, keywords: int = 4) -> DataFrame:
    """group, n, signature, keywords, examples of each cluster, largest first; rows without a group are left out.

    The signature is the first non-empty text (white space collapsed, 120 characters). Tokens are runs of
    letters, digits and apostrophes of the lower-cased text: keywords are the most frequent of the first 12 of
    each row, ties by first place, and examples join the first 16 (140 characters). First means by ``order``.
    """
    body = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    used = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(order).alias("o"), body.alias("t"))
    filled = used.withColumn("tokens", F.regexp_extract_all(F.lower("t"), F.lit("[a-z0-9']+"), F.lit(0)))
    first = F.min_by(F.when(F.col("t") != "", F.col("t")), F.when(F.col("t") != "", F.col("o")))
    counts = used.groupBy("grp").agg(F.count("*").alias("n"), F.coalesce(F.substring(first, 1, 120), F.lit("")).alias("signature"))
    words = filled.select("grp", "o", F.posexplode(F.slice("tokens", 1, 12)).alias("p", "w"))
    ranked = words.groupBy("grp", "w").agg(F.count("*").alias("c"), F.min(F.struct("o", "p")).alias("at"))
    kept = top_per_key(ranked, "grp", [F.desc("c"), F.asc("at"), F.asc("w")], keywords)
    keyed = kept.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]), ",").alias("keywords"))
    shown = filled.where(F.size("tokens") > 0).withColumn("e", F.substring(F.array_join(F.slice("tokens", 1, 16), " "), 1, 140))
    listed = listed_per_key(shown, "grp", [F.asc("o")], examples, F.col("e"), "examples", " || ")
    made = counts.join(keyed, "grp", "left").join(listed, "grp", "left")
    return made.select(F.col("grp").alias(group), "n", "signature", F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("examples", F.lit("")).alias("examples")).orderBy(F.desc("n"), F.col(group).cast("string"))


def stratified_split(subjects: DataFrame, subject: str, stratum: str, key: Column | None = None, train: float = 0.70, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds split (train, val, test) by rank within the stratum, in the order of a hash (or ``key``)."""
    order = F.xxhash64(F.col(subject), F.lit(seed)) if key is None else key
    share = F.percent_rank().over(Window.partitionBy(stratum).orderBy(order, F.col(subject)))
    return subjects.withColumn("split", F.when(share < train, F.lit("train")).when(share < train + validation, F.lit("val")).otherwise(F.lit("test")))


def bounded_prefix(rows: DataFrame, order: str, group: str, most_rows: int, least_groups: int, least_rows: int) -> DataFrame:
    """Rows up to the first at which both ``most_rows`` rows and ``least_groups`` groups of ``least_rows`` rows are reached.

    The threshold is found from the order values at which groups become eligible, so only groups are sorted.
    """
    place = Window.partitionBy(group).orderBy(order)
    eligible = rows.withColumn("__n", F.row_number().over(place)).where(F.col("__n") == least_rows).select(F.col(order).alias("o")).orderBy("o").limit(least_groups)
    enough = eligible.agg(F.when(F.count("*") == least_groups, F.max("o")).alias("by_group"))
    by_rows = rows.select(F.col(order).alias("o")).orderBy("o").limit(most_rows).agg(F.when(F.count("*") == most_rows, F.max("o")).alias("by_rows"))
    limit = enough.join(by_rows).select(F.when(F.col("by_group").isNotNull() & F.col("by_rows").isNotNull(), F.greatest("by_group", "by_rows")).alias("last"))
    return rows.join(F.broadcast(limit)).where(F.col("last").isNull() | (F.col(order) <= F.col("last"))).drop("last")


def boosted(text: Column, query: Column, times: int = 20) -> Column:
    """A target's text with its query appended many times; the source table stays as it is."""
    return F.concat(text, F.repeat(F.concat(F.lit(" "), query), times))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def report_notes(studies: DataFrame, reports: DataFrame, labels: DataFrame) -> DataFrame:
    """Radiology notes of studies (subject_id, study_id, view, gender): the report's text, or what the metadata says; the label's diagnosis.

    Studies without ids are left out. reports: study_id, text; labels: study_id, diagnosis.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    used = studies.select(blank("subject_id").alias("subject"), blank("study_id").alias("study"), "view", "gender").where("subject is not null and study is not null")
    texts = reports.select(F.col("study_id").cast("string").alias("study"), F.nullif("text", F.lit("")).alias("report"))
    named = labels.select(F.col("study_id").cast("string").alias("study"), "diagnosis")
    told = F.concat(F.lit("MIMIC-CXR study "), "study", F.lit(" for patient "), "subject", F.lit(". View position "), F.coalesce("view", F.lit("unknown")), F.lit("."))
    text = F.regexp_replace(F.coalesce("report", told), r"\[\*\*.*?\*\*\]", "")
    diagnosis = F.coalesce("diagnosis", F.lit("cxr_unknown"))
    met = used.join(texts, "study", "left").join(named, "study", "left")
    return met.select(F.concat(F.lit("CXR_"), "subject").alias("patient_id"), F.concat(F.lit("CXR_"), "study").alias("note_id"), F.lit("radiology").alias("note_type"), F.lit("radiology").alias("specialty"), F.lit(-1).alias("age"), F.coalesce(F.nullif("gender", F.lit("")), F.lit("U")).alias("gender"), diagnosis.alias("primary_diagnosis"), diagnosis.alias("diagnosis"), text.alias("text"), F.lit("").alias("keywords"))


def subject_groups(sessions: DataFrame, subject: str, session: str, label: str, order: str) -> DataFrame:
    """subject, sessions (sorted ids), n and the label of its first session in order."""
    return sessions.groupBy(subject).agg(F.array_sort(F.collect_list(session)).alias("sessions"), F.count("*").alias("n"), F.min_by(label, order).alias(label))


def retrieval_log(sessions: DataFrame, notes_table: DataFrame, session: str = "vignette_id", chars: int = 200) -> DataFrame:
    """session, query_index, query_text, target_note_id, target_text_preview of every query; unknown targets have empty previews."""
    each = sessions.select(session, F.posexplode("queries").alias("query_index", "q")).select(session, "query_index", F.col("q.text").alias("query_text"), F.coalesce("q.target_note_id", F.lit("unknown")).alias("target_note_id"))
    shown = notes_table.select(F.col("note_id").alias("target_note_id"), F.substring("text", 1, chars).alias("target_text_preview"))
    return each.join(shown, "target_note_id", "left").select(session, "query_index", "query_text", "target_note_id", F.coalesce("target_text_preview", F.lit("")).alias("target_text_preview"))
