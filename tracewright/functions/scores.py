"""Scores over columns: pillars, the weighted risk, severity bands, fusion, floors, attribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the pillars, floors and ceiling of the verdicts.
WEIGHTS = {"auth": 0.20, "text": 0.35, "url": 0.25, "network": 0.10, "entropy": 0.10}
FLOORS = {"Phishing": 60, "Fraud-Related": 60, "Impersonated": 45, "Suspicious": 25}
LEGITIMATE_CEILING, VIOLENT_FLOOR = 40, 50
SEVERITIES = ["info", "low", "medium", "high", "critical"]


def clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Null and NaN count as the lower bound."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.nanvl(F.coalesce(c.cast("double"), F.lit(lo)), F.lit(lo))))


def severity_rank(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES):
        out = F.when(c == name, i).otherwise(out)
    return out


def severity_band(score: Column, has_findings: Column) -> Column:
    """Bands at 25, 50 and 75; info only for 0 without findings."""
    v = clamp(score)
    return F.when((v <= 0) & ~has_findings, "info").when(v < 25, "low").when(v < 50, "medium").when(v < 75, "high").otherwise("critical")


def _penalty(c: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def pillar_auth(spf: Column, dkim: Column, dmarc: Column, reject: Column, misaligned: Column, protected: Column) -> Column:
    """Penalties of failed and missing authentication, within 0 and 100. misaligned: how many misalignments are explicit."""
    p = _penalty(spf, {"fail": 45, "softfail": 25, "none": 15, "neutral": 15, "unverifiable": 10, "temperror": 10, "permerror": 10})
    p = p + _penalty(dkim, {"fail": 35, "none": 10, "unverifiable": 5, "temperror": 5, "permerror": 5})
    p = p + F.when((dmarc == "fail") & reject, 60).otherwise(_penalty(dmarc, {"fail": 40, "none": 10}))
    failed = spf.isin("fail", "softfail") | (dkim == "fail") | (dmarc == "fail")
    return clamp(p + 15 * misaligned + F.when(protected & failed, 20).otherwise(0))


def pillar_text(nlp: Column, worst_pattern: Column) -> Column:
    return clamp(100 * (0.7 * nlp + 0.3 * worst_pattern))


def pillar_url(score: Column, lookalike: Column, age_days: Column, disposable: Column, model: Column, freemail: Column | None = None, resolves: Column | None = None, has_mx: Column | None = None) -> Column:
    """The highest floor that holds, and half of what is left in proportion to the model's probability.

    Free-mail domains have no floor for their age or their DNS. resolves and has_mx are the sender's, null where they
    weren't looked up.
    """
    zero, no = F.lit(0.0), F.lit(False)
    own = ~F.coalesce(freemail, no) if freemail is not None else F.lit(True)
    dead = F.coalesce(~resolves, no) if resolves is not None else no
    deaf = F.coalesce(~has_mx, no) & F.coalesce(resolves, no) if has_mx is not None and resolves is not None else no
    floors = [
        100 * F.least(F.greatest(score, zero), F.lit(1.0)),
        F.when(F.coalesce(lookalike, no), 85.0).otherwise(zero),
        F.when(own & (age_days < 30), 75.0).when(own & (age_days < 90), 50.0).otherwise(zero),
        F.when(F.coalesce(disposable, no), 60.0).otherwise(zero),
        F.when(own & dead, 70.0).when(own & deaf, 40.0).otherwise(zero),
    ]
    floor = F.greatest(*floors)
    return clamp(floor + (100 - floor) * 0.5 * F.coalesce(model, zero))


#: What each anomaly of delivery weighs, once a message.
ROUTING = {"forged_received_order": 40, "negative_delay": 25, "large_delay": 10, "no_tls": 10, "helo_mismatch": 10, "unparseable": 5}


def routing_part(anomalies: Column, n_hops: Column, any_public: Column, origin_confidence: Column) -> Column:
    """What a message's way says, 0 to 100. anomalies: of all hops; origin_confidence: null where there is no origin."""
    weights = [F.when(F.array_contains(anomalies, name), w).otherwise(0) for name, w in ROUTING.items()]
    more = F.when(n_hops == 0, 25).when(~any_public, 20).otherwise(0) + F.when(origin_confidence < 0.5, 10).otherwise(0)
    return clamp((sum(weights[1:], weights[0]) + more).cast("double"))


def intel_part(blacklisted_ip: Column, tor: Column, blacklisted_infra: Column, worst_related: Column) -> Column:
    """What is known of the addresses and of related cases; worst_related: the highest risk among these, null for none."""
    flags = [(blacklisted_ip, 80.0), (tor, 85.0), (blacklisted_infra, 75.0)]
    return F.greatest(*[F.when(flag, w).otherwise(0.0) for flag, w in flags], F.coalesce(40 + 0.4 * worst_related, F.lit(0.0)))


def pillar_network(parts: list[Column]) -> Column:
    """The strongest part, and a fifth of the mean of the others."""
    top = F.greatest(*parts)
    rest = sum(parts[1:], parts[0]) - top
    return clamp(top + 0.2 * rest / max(1, len(parts) - 1))


def pillar_entropy(score: Column, packed_and_high: Column) -> Column:
    return clamp(F.greatest(100 * score, F.when(packed_and_high, 90.0).otherwise(0.0)))


def risk(pillars: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum, weights normalised, rounded half to even; sixth decimals first, so that sums in any order agree."""
    total = sum(weights.values())
    terms = [pillars[k] * (w / total) for k, w in weights.items()]
    return F.bround(F.round(sum(terms[1:], terms[0]), 6), 0).cast("int")


def fuse_confidence(rule: Column, model: Column, p: Column, risk_score: Column) -> Column:
    """Confidence of the rules' category beside the model's; p: the model's probability of the rules' category."""
    legit = rule == "Legitimate"
    sure = (~legit & (risk_score >= 50)) | (legit & (risk_score < 25))
    return F.when(rule == model, F.least(F.lit(0.98), 0.75 + 0.25 * p)).otherwise(F.when(sure, 0.7).otherwise(0.6))


def guarded(category: Column, risk_score: Column, violent: Column) -> Column:
    """struct<category, risk>: a legitimate verdict has a ceiling, the others have floors."""
    raised = F.when((category == "Legitimate") & (risk_score >= LEGITIMATE_CEILING), "Suspicious").otherwise(category)
    floor = F.lit(0)
    for name, least in FLOORS.items():
        floor = F.when(raised == name, least).otherwise(floor)
    floor = F.when((violent >= 0.5) & (raised != "Legitimate"), F.greatest(floor, F.lit(VIOLENT_FLOOR))).otherwise(floor)
    return F.struct(raised.alias("category"), F.greatest(risk_score, floor).alias("risk"))


def ladder(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The category of the first rule that holds."""
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


#: Categories of verdicts, the worst first.
PHISHING, FRAUD, IMPERSONATED, SUSPICIOUS, LEGITIMATE = "Phishing", "Fraud-Related", "Impersonated", "Suspicious", "Legitimate"
#: Signals that threat_rules reads: confidences of patterns, counts, truths, and the text model's category with its probability.
CONFIDENCES = "payment_diversion fake_invoice credential_harvesting executive_impersonation extortion violent_threat investment_scam callback_scam".split()
COUNTS = "risk financial_terms credential_terms payment_handles pressure pushes high_urls medium_urls critical_urls critical_files login_files severe_findings".split()
TRUTHS = "harvest_link lookalike_link internal_sender display_spoof lookalike_sender lookalike_other brand_variant spf_fail dmarc_fail auth_failure protected".split()


def threat_rules(signals: dict[str, Column]) -> list[tuple[str, str, Column]]:
    """(category, name, test) of all rules; the first category with a rule that holds wins. Signals that aren't given are
    zero, false or, for the model, Legitimate."""
    zero = {**dict.fromkeys(CONFIDENCES, F.lit(0.0)), **dict.fromkeys(COUNTS, F.lit(0)), **dict.fromkeys(TRUTHS, F.lit(False))}
    g = {k: F.coalesce(signals[k], z) if k in signals else z for k, z in zero.items()}
    model, p = (F.coalesce(signals[k], z) if k in signals else z for k, z in (("model", F.lit(LEGITIMATE)), ("p", F.lit(0.0))))
    any_ = lambda k: g[k] > 0
    likely = {k: g[k] >= 0.5 for k in CONFIDENCES}
    says = lambda category: (model == category) & (p >= 0.6)
    credentials_first = likely["credential_harvesting"] & (g["credential_harvesting"] >= F.greatest(g["payment_diversion"], g["fake_invoice"]))
    asks = any_("credential_terms") | any_("financial_terms") | any_("payment_handles")
    of = {
        (PHISHING, 0): {"login_file": any_("login_files"), "critical_link": any_("critical_urls"), "harvest_link": g["harvest_link"]},
        (FRAUD, 1): {
            "payment_diversion": likely["payment_diversion"] & ~credentials_first,
            "fake_invoice": likely["fake_invoice"] & ~credentials_first,
            "extortion": likely["extortion"],
            "investment_scam": likely["investment_scam"],
            "callback_scam": likely["callback_scam"],
            "handles_and_push": any_("payment_handles") & ~g["internal_sender"] & any_("pushes"),
            "financial_lure": (g["financial_terms"] >= 2) & any_("pressure") & (g["risk"] >= 40) & ~credentials_first & ~any_("high_urls"),
            "model_fraud": says(FRAUD) & any_("financial_terms") & ~likely["credential_harvesting"] & ~any_("high_urls"),
            "executive_and_money": likely["executive_impersonation"] & any_("financial_terms"),
        },
        (PHISHING, 2): {
            "credential_harvesting": likely["credential_harvesting"],
            "high_link_and_credentials": any_("high_urls") & any_("credential_terms"),
            "lookalike_link_and_request": g["lookalike_link"] & asks,
            "model_phishing": says(PHISHING) & any_("medium_urls"),
            "critical_file_and_credentials": any_("critical_files") & any_("credential_terms"),
        },
        (IMPERSONATED, 3): {
            "display_spoof": g["display_spoof"] & ~g["brand_variant"],
            "executive_impersonation": g["executive_impersonation"] >= 0.35,
            "lookalike_sender": (g["lookalike_sender"] & ~g["brand_variant"]) | g["lookalike_other"],
            "protected_domain_failed": (g["spf_fail"] | g["dmarc_fail"]) & g["protected"],
            "model_impersonated": says(IMPERSONATED) & g["auth_failure"],
        },
        (SUSPICIOUS, 4): {
            "violent_threat": likely["violent_threat"],
            "risk": g["risk"] >= 25,
            "severe_findings": any_("severe_findings"),
            "model_doubts": (model != LEGITIMATE) & (p >= 0.6),
        },
    }
    return [(category, name, test) for (category, _), rules in of.items() for name, test in rules.items()]


def verdict(rules: list[tuple[str, str, Column]], otherwise: str = LEGITIMATE) -> Column:
    """struct<category, reasons>: the category of the first rule that holds, and the names of all of its stage that do.

    Rules of one category that stand together are a stage.
    """
    stages: list[tuple[str, list[tuple[str, Column]]]] = []
    for category, name, test in rules:
        if not stages or stages[-1][0] != category:
            stages.append((category, []))
        stages[-1][1].append((name, F.coalesce(test, F.lit(False))))
    out = F.struct(F.lit(otherwise).alias("category"), F.array().cast("array<string>").alias("reasons"))
    for category, tests in reversed(stages):
        reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
        out = F.when(F.size(reasons) > 0, F.struct(F.lit(category).alias("category"), reasons.alias("reasons"))).otherwise(out)
    return out


def attribution(category: Column, confidence: Column, s: dict[str, Column]) -> Column:
    """struct<source, confidence>: where an attack comes from, by the first source that fits.

    confidence: of the category, which a legitimate sender keeps. s: truths lookalike, spf_fail, dmarc_fail, auth_missing,
    established (of a year or more, or protected), spf_pass, dkim_pass, aligned, freemail, display_spoof, tor, disposable,
    vpn, hosting, and age_days; what isn't given is false, or unknown.
    """
    is_ = lambda k: F.coalesce(s[k], F.lit(False)) if k in s else F.lit(False)
    age = s.get("age_days", F.lit(None).cast("int"))
    young = F.coalesce(age < 90, F.lit(False))
    attack = category.isin(PHISHING, FRAUD, IMPERSONATED)
    direct = {"tor": (is_("tor"), 0.85), "disposable": (is_("disposable"), 0.8), "young": (young & ~is_("freemail"), 0.75), "vpn": (is_("vpn"), 0.7), "hosting": (is_("hosting"), 0.65)}
    infra = F.greatest(*[F.when(test, w).otherwise(0.0) for test, w in direct.values()])
    of = lambda source, c: F.struct(F.lit(source).alias("source"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    return (
        F.when(category == LEGITIMATE, of("legitimate_sender", clamp(confidence, 0, 1)))
        .when(is_("lookalike"), of("lookalike_domain", F.when(young, 0.9).otherwise(0.8)))
        .when((is_("spf_fail") | is_("dmarc_fail") | is_("auth_missing")) & is_("established"), of("spoofed_domain", F.when(is_("dmarc_fail"), 0.85).otherwise(0.75)))
        .when(is_("spf_pass") & is_("dkim_pass") & is_("aligned") & attack & ~is_("freemail"), of("compromised_account", 0.7))
        .when(infra > 0, of("direct_attacker_infrastructure", infra))
        .when(is_("freemail") & (is_("display_spoof") | category.isin(FRAUD, PHISHING)), of("direct_attacker_infrastructure", F.when(is_("display_spoof"), 0.6).otherwise(0.55)))
        .otherwise(of("undetermined", 0.3))
    )
