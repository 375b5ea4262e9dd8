"""Rule-based scope, intent and routing of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.text import ENTITIES, any_marker, literal_array, normalize, search_terms, strip

# Terms of the domain and outside it, intents in order of precedence, follow-up prefixes, failure markers.
DOMAIN_TERMS = ["استقرار", "دیپلوی", "deploy", "دیتابیس", "postgresql", "mysql", "redis", "دامنه", "dns", "برنامه", "ابر", "شبکه خصوصی", "لاگ", "object storage", "فضای ابری", "کوبرنتیز", "docker"]
OUTSIDE_TERMS = ["آب و هوا", "فال", "نتیجه فوتبال", "فیلم سینمایی", "پزشکی", "نسخه دارویی", "بورس", "قیمت دلار", "آشپزی"]
INTENTS = {
    "troubleshoot": ["خطا", "ارور", "کار نمی", "وصل نمی", "مشکل", "لاگ"],
    "deploy": ["استقرار", "دیپلوی", "deploy", "راه اندازی برنامه"],
    "connect": ["اتصال", "وصل", "connection", "شبکه خصوصی"],
    "compare": ["مقایسه", "تفاوت", "بهتر است"],
    "plan_or_cost": ["هزینه", "قیمت", "پلن", "plan"],
    "account_or_team": ["حساب", "تیم", "دسترسی کاربر"],
    "locate_docs": ["مستند", "لینک", "صفحه راهنما"],
    "configure": ["تنظیم", "کانفیگ", "config", "متغیر محیطی"],
}
TOPICS = [*ENTITIES, "دامنه", "dns", "شبکه", "object", "storage", "کوبرنتیز"]
FOLLOW_UPS = ["پس ", "حالا ", "بعد ", "کجا ", "چطور ", "چجوری ", "این ", "اون ", "آن "]
FAILURES = ["جواب نداد", "کار نکرد", "حل نشد", "نتیجه نداد", "هنوز مشکل دارم"]


def scope(query: Column, domain: Sequence[str] = (), outside: Sequence[str] = (), intents: dict[str, Sequence[str]] | None = None) -> Column:
    """struct<in_scope, intent, reason>. Further domain terms (a product's name), outside terms and intents may be given."""
    normal = normalize(query)
    known = any_marker(normal, [*DOMAIN_TERMS, *domain])
    out = ~known & any_marker(normal, [*OUTSIDE_TERMS, *outside])
    intent, keyword = F.when(out, "out_of_scope"), F.lit(False)
    for name, terms in (intents or INTENTS).items():
        met = any_marker(normal, terms)
        intent, keyword = intent.when(met, name), keyword | met
    reason = F.when(out, "explicit_other_topic").when(keyword, "intent_keyword").when(known, "domain_keyword").otherwise("domain_unverified")
    return F.struct((~out).alias("in_scope"), intent.otherwise("explain").alias("intent"), reason.alias("reason"))


def route(query: Column, intent: Column, documents: Column, contradictory: Column) -> Column:
    """struct<tier, reason, max_output_tokens>: large for hard intents, many documents, long or disputed questions."""
    large = intent.isin("troubleshoot", "compare") | (documents > 2) | (F.length(query) > 600) | contradictory
    return F.when(large, F.struct(F.lit("large").alias("tier"), F.lit("complex_grounded").alias("reason"), F.lit(1200).alias("max_output_tokens"))).otherwise(F.struct(F.lit("small").alias("tier"), F.lit("simple_grounded").alias("reason"), F.lit(700).alias("max_output_tokens")))


def clarification_can_help(query: Column, intent: Column, entities: Sequence[str] = ENTITIES) -> Column:
    return (intent == "troubleshoot") | ~F.arrays_overlap(search_terms(query), literal_array(entities))


def estimated_cost(tier: Column, input_tokens: Column, output_tokens: Column, rates: dict[str, tuple[float, float]]) -> Column:
    """Dollars at rates per million tokens: tier -> (input, output)."""
    small, large = rates["small"], rates["large"]
    rate = lambda k: F.when(tier == "small", small[k]).otherwise(large[k])
    return F.round((input_tokens * rate(0) + output_tokens * rate(1)) / 1_000_000, 8)


def turn_outcome(t: dict[str, Column]) -> Column:
    """struct<outcome, reason, source> of a turn, from what is known of it; the first rule that applies decides.

    t: in_scope, scope_reason, failure_count, after_support, sufficient, evidence_reason, clarified (follows a
    clarification), follow_up, can_help (a clarification can), cache (hit, miss, invalid or bypass),
    input_tokens, max_input_tokens, first and repair (a call's result: valid, abstained, failed, or another verdict
    of the validator), fallback (whether a sentence can be quoted).
    """
    said = lambda outcome, reason, source=None: F.struct(F.lit(outcome).alias("outcome"), (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason"), F.lit(source).cast("string").alias("source"))
    quoted = F.when(t["fallback"], said("answered", None, "extractive_fallback"))
    provider_lost = quoted.otherwise(said("error", "provider_failed"))
    not_grounded = quoted.when(t["clarified"], said("support", "model_abstained")).when(t["can_help"], said("clarification", "model_abstained")).otherwise(said("support", "model_abstained"))
    unfit = ~F.coalesce(t["first"], F.lit("")).isin("valid", "abstained", "failed")
    return (
        F.when(~t["in_scope"], said("out_of_scope", t["scope_reason"]))
        .when(t["failure_count"] >= 2, said("support", "repeated_failure"))
        .when(t["after_support"], said("support", "support_continuation"))
        .when(~t["sufficient"] & t["clarified"], said("support", t["evidence_reason"]))
        .when(~t["sufficient"] & (t["scope_reason"] == "domain_unverified") & ~t["follow_up"], said("out_of_scope", t["scope_reason"]))
        .when(~t["sufficient"] & t["can_help"], said("clarification", t["evidence_reason"]))
        .when(~t["sufficient"], said("support", t["evidence_reason"]))
        .when(t["cache"] == "hit", said("answered", None, "cache"))
        .when(t["input_tokens"] > t["max_input_tokens"], said("support", "token_budget_exceeded"))
        .when(t["first"] == "valid", said("answered", None, "model"))
        .when(t["first"] == "failed", provider_lost)
        .when(t["first"] == "abstained", not_grounded)
        .when(unfit & (t["repair"] == "valid"), said("answered", None, "repair"))
        .when(unfit & (t["repair"] == "failed"), provider_lost)
        .otherwise(not_grounded)
    )


# Who may speak in a session.
ROLES = ["user", "assistant"]


def role_allowed(role: Column) -> Column:
    return F.coalesce(role.isin(*ROLES), F.lit(False))


def broken(rows: DataFrame, rule: str, condition: Column) -> DataFrame:
    """(rule, violations): one row."""
    return rows.agg(F.count_if(condition).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


# What a request may hold.
IDENTIFIER = r"^[\p{L}\p{N}_-]+\z"
SURFACES, LOCALE, PROTOCOL = ["popup", "page"], "fa-IR", "1"


def request_problem(r: dict[str, Column], most_chars: int) -> Column:
    """The first thing wrong with a request (protocol_version, session_id, message_id, text, surface, locale), else null."""
    text = strip(r["text"])
    sized = lambda c, least: F.coalesce(F.length(c).between(least, 128) & c.rlike(IDENTIFIER), F.lit(False))
    is_one = lambda c, *values: F.coalesce(c.isin(*values), F.lit(False))
    return (
        F.when(~is_one(r["protocol_version"], PROTOCOL), "protocol_version")
        .when(~sized(r["session_id"], 20), "session_id")
        .when(~sized(r["message_id"], 8), "message_id")
        .when(F.coalesce(text, F.lit("")) == "", "text")
        .when(~is_one(r["surface"], *SURFACES), "surface")
        .when(~is_one(r["locale"], LOCALE), "locale")
        .when(F.length(text) > most_chars, "input_too_long")
    )
