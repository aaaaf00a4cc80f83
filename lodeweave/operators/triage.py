"""Faults, recovery actions and error classes, as decision expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Recovery by fault, as (fault, action, first wait in ms, factor, most attempts).
RECOVERY = (
    ("selector_broken", "retry_with_strategy", None, None, None),
    ("blocked", "backoff", 1_800_000, 1.0, 1),
    ("rate_limited", "backoff", 60_000, 2.0, 3),
    ("network_error", "backoff", 1_000, 2.0, 3),
    ("unknown", "alert_only", None, None, None),
)
# The codes of errors, and the way browsing goes on after a block.
ERROR_CODES = ("CAPTCHA_REQUIRED", "CAPTCHA_RECOVER_FAIL", "BLOCKED_BY_GOOGLE", "NAV_TIMEOUT", "EXTRACT_FAILED", "PRIVATE_ADDRESS", "PROFILE_MISSING", "PARSER_STALE", "RATE_LIMITED", "INTERNAL")
CAPTCHA_MODES = ("cloud_fail_fast", "remote_debug", "always_headed", "notify_spawn")
# Messages and advice that go with the codes.
CAPTCHA_IN_CLOUD = "Google CAPTCHA encountered. Cloud mode cannot solve interactively."
ADVICE = {
    "CAPTCHA_REQUIRED": "Run on an interactive desktop session, or refresh profile: npm run bootstrap",
    "CAPTCHA_RECOVER_FAIL": "Solve CAPTCHA in opened browser, or run: npm run bootstrap",
    "PROFILE_MISSING": "Run: npm run bootstrap",
    "PARSER_STALE": "Selector may need update. Check repo for newer version.",
}


def fault(url: Column, status: Column, elapsed_ms: Column, results: Column, h3: Column, geometric: Column, recent_zeros: Column) -> Column:
    """Kind of fault of one search; the first rule that holds decides.  geometric and recent_zeros may be NULL."""
    broken = (h3 > 5) & (results == 0)
    votes = broken.cast("int") + F.coalesce(geometric < 0.4, F.lit(False)).cast("int") + F.coalesce(recent_zeros >= 2, F.lit(False)).cast("int")
    return (
        F.when(url.contains("/sorry/"), "blocked")
        .when(status == 429, "rate_limited")
        .when(status >= 400, "network_error")
        .when((votes >= 2) & (status == 200), "selector_broken")
        .when((elapsed_ms > 15_000) & results.between(1, 2), "rate_limited")
        .when(broken & (status == 200), "selector_broken")
        .otherwise("unknown")
    )


def describe(kind: Column, results: Column, h3: Column, status: Column, geometric: Column) -> Column:
    """One line of text about a fault; the status only if it is not 200, the geometry only if there is one."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    return F.concat_ws(" ", part("type", kind), part("results", results), part("h3", h3), F.when(status != 200, part("status", status)), F.when(geometric.isNotNull(), F.format_string("geom=%.2f", geometric)))


def recovery(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RECOVERY), "fault string, action string, initial_ms bigint, factor double, max_attempts int")


def error_info(message: Column, captcha: Column | bool = False, cloud: Column | bool = False, action: Column | None = None) -> Column:
    """STRUCT<code, message, retryable, retry_after_ms, user_action> of an error; NULL for no message.

    captcha: the error is a captcha met while browsing; cloud: nobody can solve it; action: advice of its own.
    """
    as_col = lambda x: F.lit(x) if isinstance(x, bool) else x

    def say(code: str, text: Column = message, again: bool = False, wait: int | None = None, own: Column | None = None) -> Column:
        advice = F.lit(ADVICE.get(code))
        if own is not None:
            advice = F.coalesce(own, advice)
        return F.struct(F.lit(code).alias("code"), text.alias("message"), F.lit(again).alias("retryable"), F.lit(wait).cast("bigint").alias("retry_after_ms"), advice.alias("user_action"))

    has = lambda p: message.rlike(f"(?i){p}")
    return (
        F.when(message.isNull(), F.lit(None))
        .when(as_col(captcha) & as_col(cloud), say("CAPTCHA_REQUIRED", F.lit(CAPTCHA_IN_CLOUD), own=action))
        .when(as_col(captcha), say("CAPTCHA_RECOVER_FAIL", own=action))
        .when(has("profile not initialized"), say("PROFILE_MISSING"))
        .when(has("timeout"), say("NAV_TIMEOUT", again=True, wait=1_000))
        .when(has("429|too many requests|rate.?limit"), say("RATE_LIMITED", again=True, wait=60_000))
        .when(has("parser.?stale|h3.+but.+0 results"), say("PARSER_STALE"))
        .when(has("private/internal address|loopback"), say("PRIVATE_ADDRESS"))
        .otherwise(say("INTERNAL", F.substring(message, 1, 500)))
    )


def is_error_code(text: Column) -> Column:
    return text.isin(*ERROR_CODES)


def blocked(url: Column, body: Column, html: Column | None = None) -> Column:
    """Whether a page is a block or consent page, by its address, its text, or a captcha form or frame in its HTML."""
    out = url.contains("/sorry/") | url.contains("consent.google.") | F.coalesce(body.rlike("(?i)unusual traffic|systems have detected|are not a robot"), F.lit(False))
    if html is not None:
        form = html.rlike(r"""(?is)<form\b[^>]*\sid\s*=\s*["']?captcha-form["'\s>]""")
        frame = html.rlike(r"""(?is)<iframe\b[^>]*\ssrc\s*=\s*("[^"]*recaptcha|'[^']*recaptcha|[^"'\s>]*recaptcha)""")
        out = out | F.coalesce(form | frame, F.lit(False))
    return out


def h3_in_message(message: Column) -> Column:
    return F.regexp_extract(message, r"(?i)(\d+)\s*h3", 1).try_cast("int")


def captcha_mode(cloud: Column, headless: Column, remote_debug: Column) -> Column:
    return F.when(cloud, CAPTCHA_MODES[0]).when(remote_debug, CAPTCHA_MODES[1]).when(~headless, CAPTCHA_MODES[2]).otherwise(CAPTCHA_MODES[3])


def extract_outcome(content: Column, error: Column) -> Column:
    """STRUCT<code, message, retryable, retry_after_ms>: NULL unless there is an error and no content; an empty one is none."""
    failed = (F.coalesce(F.length(error), F.lit(0)) > 0) & (F.coalesce(F.length(content), F.lit(0)) == 0)
    return F.when(failed, F.struct(F.lit("EXTRACT_FAILED").alias("code"), error.alias("message"), F.lit(True).alias("retryable"), F.lit(1_000).cast("bigint").alias("retry_after_ms")))


def error_text(info: Column) -> Column:
    """An error as text for a reader: code and message, advice and wait where there are any."""
    advice = F.when(F.length(info["user_action"]) > 0, F.concat(F.lit("\nAction: "), info["user_action"]))
    wait = F.when(info["retry_after_ms"] > 0, F.concat(F.lit("\nRetry after: "), info["retry_after_ms"].cast("string"), F.lit("ms")))
    return F.concat(F.lit("Error ["), info["code"], F.lit("]: "), info["message"], F.coalesce(advice, F.lit("")), F.coalesce(wait, F.lit("")))


def response(data: Column, error: Column, meta: Column) -> Column:
    """STRUCT<text, body, is_error> of an answer: the error's text and JSON, or the data with its meta as JSON."""
    failed = error.isNotNull()
    body = F.when(failed, F.to_json(F.struct(error.alias("error"), meta.alias("meta")))).otherwise(F.to_json(F.struct(data.alias("data"), meta.alias("meta"))))
    return F.struct(F.when(failed, error_text(error)).otherwise(body).alias("text"), body.alias("body"), failed.alias("is_error"))
