"""Screening: ordered checks with one reject reason a row, first-wins dedupe, quotas and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import hashing, text


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds; null for none. Later checks are not worked out."""
    return F.coalesce(*[F.when(check, F.lit(reason)) for check, reason in checks])


#: Bytes of a record as JSON.
MOST_BYTES = 5 << 20
#: Tokens that a chat message costs besides its text.
OVERHEAD = 4


def _vague(title: Column, body: Column) -> Column:
    name = F.lower(text.strip(F.coalesce(text.falsy(title), F.lit("Untitled"))))
    return name.startswith("list of") | name.endswith("(disambiguation)") | F.contains(F.lower(F.substring(body, 1, 512)), F.lit("may refer to"))


def _json_bytes(**fields: Column) -> Column:
    """Bytes of the fields as JSON with a blank after each comma and colon."""
    return F.octet_length(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))) + (2 * len(fields) - 1)


def survey_checks(body: Column, title: Column, chars=(10_000, 30_000), tokens=(200, 25_000), most_total: int = 100_000, control=0.01, non_latin=0.3, most_bytes: int = MOST_BYTES, prompt_tokens: int = 0, count: Column | None = None) -> Column:
    """The survey cascade, cheap checks first. body is to be stripped; prompt_tokens: what the prompt has besides title and body;
    count: the body's tokens, if a column has them."""
    body = F.coalesce(body, F.lit(""))
    name = text.strip(F.coalesce(text.falsy(title), F.lit("Untitled")))
    count = text.token_count(body) if count is None else count
    total = count + text.token_count(name) + (prompt_tokens + 2 * OVERHEAD)
    return first_reason(
        (body == "", "missing_article_text"), (F.length(body) > chars[1], "article_chars_above_max"), (F.length(body) < chars[0], "article_chars_below_min"),
        (count > tokens[1], f"article_tokens>{tokens[1]}"), (count < tokens[0], "article_too_short"),
        (text.has_nul(body), "contains_nul"), (text.control_ratio(body) > control, "control_ratio_exceeded"), (text.non_latin_ratio(body) > non_latin, "non_latin_ratio_exceeded"),
        (_vague(title, body), "disambiguation_filter"), (total > most_total, f"total_tokens>{most_total}"), (_json_bytes(title=name, article_text=body) > most_bytes, "json_bytes_exceeded"),
    )


def qa_checks(question: Column, context: Column, question_tokens=(1, 512), context_tokens=(20, 3_000), most_total: int = 8_192, control=0.01, non_latin=0.3, most_bytes: int = MOST_BYTES, prompt_tokens: int = 0) -> Column:
    """The question cascade; both texts are to be stripped."""
    question, context = F.coalesce(question, F.lit("")), F.coalesce(context, F.lit(""))
    asked, given = text.token_count(question), text.token_count(context)
    total = asked + given + (prompt_tokens + 2 * OVERHEAD)
    return first_reason(
        (question == "", "missing_question"), (context == "", "missing_context"), (text.has_nul(question) | text.has_nul(context), "contains_nul"),
        (asked > question_tokens[1], f"question_tokens>{question_tokens[1]}"), (given > context_tokens[1], f"context_tokens>{context_tokens[1]}"),
        (given < context_tokens[0], "context_too_short"), (asked < question_tokens[0], "question_too_short"),
        (text.control_ratio(F.concat(question, context)) > control, "control_ratio_exceeded"), (text.non_latin_ratio(context) > non_latin, "non_latin_ratio_exceeded"),
        (total > most_total, f"total_tokens>{most_total}"), (_json_bytes(question=question, context=context) > most_bytes, "json_bytes_exceeded"),
    )


def maths_checks(question: Column, answer: Column, most_question: int = 1_500, most_answer: int = 256, most_total: int = 8_192, control=0.01, non_latin=0.3, prompt_tokens: int = 0) -> Column:
    """The cascade for short reasoning tasks; answer is JSON."""
    question, answer = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("null"))
    asked, given = text.token_count(question), text.token_count(answer)
    return first_reason(
        (question == "", "missing_question"), (text.has_nul(question) | text.has_nul(answer), "contains_nul"),
        (asked > most_question, f"question_tokens>{most_question}"), (given > most_answer, f"answer_tokens>{most_answer}"),
        (text.control_ratio(F.concat(question, answer)) > control, "control_ratio_exceeded"), (text.non_latin_ratio(F.concat_ws(" ", question, answer)) > non_latin, "non_latin_ratio_exceeded"),
        (asked + given + (prompt_tokens + 2 * OVERHEAD) > most_total, f"total_tokens>{most_total}"),
    )


def screened(rows: DataFrame, reason: Column, body: str, order: str, duplicate: str = "duplicate_article") -> DataFrame:
    """rows with `reason`; of those that pass, all but the first in order with the same normalised text are duplicates."""
    marked = rows.withColumn("reason", reason)
    out = marked.withColumn("digest", F.when(F.col("reason").isNull(), hashing.text_digest(F.col(body))))
    # Keys are never null: no filter is inferred that would work the reason out again, and rejected rows, which have
    # no digest, are spread by their order. Partial aggregation keeps a hot digest small.
    firsts = out.groupBy(F.coalesce("digest", F.lit("")).alias("__key")).agg(F.min(order).alias("first"))
    own = F.coalesce(F.col("digest"), F.concat(F.lit("-"), F.coalesce(F.col(order).cast("string"), F.lit(""))))
    out = out.withColumn("__key", own).join(firsts, "__key", "left").drop("__key")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col(order) > F.col("first"), duplicate))).drop("first")


def report(marked: DataFrame, domain: str) -> DataFrame:
    """Accepted and rejected rows by domain and reason."""
    return marked.groupBy(F.col(domain).alias("domain"), F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def until_quota(marked: DataFrame, domain: str, order: str, target: int) -> DataFrame:
    """Rows met before the domain's target of accepted rows was reached: accepted and rejected ones."""
    accepted = F.col("reason").isNull().cast("int")
    last = Window.partitionBy(domain).orderBy(order)
    edge = marked.filter("reason is null").withColumn("__n", F.row_number().over(last)).filter(F.col("__n") == target).select(F.col(domain).alias("__d"), F.col(order).alias("__edge"))
    met = marked.join(edge, marked[domain] == F.col("__d"), "left").filter(F.col("__edge").isNull() | (F.col(order) <= F.col("__edge")))
    return met.withColumn("accepted", accepted).drop("__d", "__edge")


def classified(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each request with its classifier label or a soft reason where there is none."""
    got = results.withColumn("__met", F.lit(True))
    reason = F.when(F.col("__met").isNull(), "classifier_missing_result").when(F.lower("error").contains("rate limit"), "classifier_rate_limited").when(F.col("error").isNotNull(), "classifier_error")
    return requests.join(got, key, "left").withColumn("soft_reason", reason).drop("__met")


def verdicts(rows: DataFrame, faults: dict[str, Column], key: str, seed: str, share: float = 0.01) -> DataFrame:
    """rows with the reasons that hold, in order, whether none does, and of those retained a share marked for audit by hash."""
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()]), lambda x: x.isNotNull())
    out = rows.withColumn("reasons", reasons).withColumn("retained", F.size("reasons") == 0)
    return out.withColumn("audited", F.col("retained") & (hashing.fraction(F.lit(seed), F.col(key)) < share))


def excerpt(body: Column, most: int = 8000) -> Column:
    """What a classifier is shown of a text."""
    return F.substring(body, 1, most)


def heading_list(body: Column, most: int = 15) -> Column:
    """The first headings of a text, for a classifier; None without any."""
    found = F.slice(text.headings(body), 1, most)
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("None")


def task_sample(rows: DataFrame, domain: str, key: str, most: int, name: str, seed: int) -> DataFrame:
    """Exactly `most` rows of each domain, or all, drawn without replacement in hash order."""
    order = Window.partitionBy(domain).orderBy(hashing.shuffle_key(F.lit(name), F.col(key), F.lit(seed)), key)
    return rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).drop("__r")
