"""Rule checks over contracts, procurements, schedules and people: columns that list what is wrong with a row.

Each takes a frame's own columns by the names in its docstring; dates are dates, "today" is a parameter, and a
missing text counts as blank, a missing number as zero. Every rule is a plain expression of its row, so a check is
part of whatever scan it stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions.text import text

# Statuses that the rules know, and their messages.
CLOSED_PROCUREMENT = ["Подана", "Победа", "Проигрыш", "Отменена"]
READY_SCHEDULE = ["Готова", "Подана"]
MANAGERS = ["Руководитель заявки", "Менеджер"]
PAID_OR_NONE = ["Полностью оплачено", "Не применяется"]
ACTS_DONE = ["Не требуются", "Подписаны полностью"]
WORK_DONE = ["Выполнен", "Закрыт"]
GAPS = ["Не подтверждено", "Частично подтверждено", "Требует уточнения", "Истечёт до подачи", "Истечёт до завершения работ"]
CONFIRMED, TO_CLARIFY = "Подтверждено", "Требует уточнения"
SUBMITTED_OR_PAUSED, MANAGERS = ["Подана", "Приостановлена"], ["Руководитель заявки", "Менеджер"]
PROVIDER = {
    "redirects": "Автоматические перенаправления запрещены", "timeout": "Таймаут должен быть от 5 до 600 секунд", "jobs": "Допускается от 1 до 4 параллельных заданий", "no-address": "Для выбранного режима требуется адрес сервера",
    "credentials": "Адрес не должен содержать учётные данные или fragment", "disabled": "У выключенного провайдера не должно быть адреса", "socket": "Для сервера на этом компьютере используйте Unix socket или Windows Named Pipe",
    "https": "Для сервера в локальной сети разрешён только HTTPS", "secret": "Секрет должен храниться в системном хранилище учётных данных", "certificate": "Нужно закрепить сертификат локального сервера",
}
COMPLEXITY = {"Низкая": (1, 24, 0), "Средняя": (2, 48, 2), "Высокая": (3, 80, 4), "Экспертная": (4, 120, 7)}
DOCUMENT_LABELS = {"education": "Диплом", "contract": "Документ-основание", "certificate": "Действующий сертификат"}
EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"


def _blank(name: str) -> Column:
    return F.trim(text(F.col(name))) == ""


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _listed(*rules: tuple[Column, Column | str]) -> Column:
    """What the rules that hold say, in their order."""
    return F.array_compact(F.array(*[F.when(holds, says if isinstance(says, Column) else F.lit(says)) for holds, says in rules]))


def plain_number(value: Column) -> Column:
    """Digits as they are shown in messages: no fraction where there is none."""
    whole = value.cast("long").cast("string")
    return F.when(value == F.floor(value), whole).otherwise(F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", ""))


def contract_checks() -> Column:
    """Array of (code, severity) for start_date, end_date, amount, paid_amount, payment_status, payment_planned,
    payment_actual, acts_status, stage."""
    says = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    status, stage = text(F.col("payment_status")), text(F.col("stage"))
    return _listed(
        (F.col("end_date") < F.col("start_date"), says("date-order", "error")),
        (_number("paid_amount") > _number("amount"), says("overpayment", "warning")),
        ((status == "Полностью оплачено") & (_number("paid_amount") <= 0), says("paid-zero", "error")),
        ((status == "Просрочено") & F.col("payment_planned").isNull(), says("overdue-no-date", "error")),
        ((status == "Не выставлено") & F.col("payment_actual").isNotNull(), says("actual-not-issued", "error")),
        ((text(F.col("acts_status")) == "Подписаны полностью") & (stage == "Подготовка"), says("acts-preparation", "error")),
    )


def procurement_warnings(today: Column) -> Column:
    """Array of messages for name, customer, subject, nmc, question_deadline, submission_deadline, status, partners
    (work_share), scenarios (name, vat_rate). A deadline holds to the end of its day."""
    share = F.aggregate(F.coalesce("partners", F.array()), F.lit(0.0), lambda s, p: s + F.coalesce(p["work_share"], F.lit(0.0)))
    wrong = F.filter(F.coalesce("scenarios", F.array()), lambda s: s["vat_rate"].isNull() | F.isnan(s["vat_rate"]) | ~s["vat_rate"].between(0, 100))
    rates = F.transform(wrong, lambda s: F.concat(F.lit("Ставка НДС сценария «"), F.when(text(s["name"]) == "", "Без названия").otherwise(s["name"]), F.lit("» должна быть от 0 до 100%.")))
    return F.concat(
        _listed(
            (_blank("name") | _blank("customer") | _blank("subject"), "Не заполнены название, заказчик или предмет закупки."),
            (_number("nmc") <= 0, "НМЦ должна быть больше нуля."),
            (F.col("question_deadline") > F.col("submission_deadline"), "Срок вопросов позже срока подачи заявки."),
            (share > 100, F.concat(F.lit("Суммарная доля партнёров "), plain_number(share), F.lit("% превышает 100%."))),
        ),
        rates,
        _listed((((F.col("submission_deadline") < today) & ~text(F.col("status")).isin(CLOSED_PROCUREMENT)), "Срок подачи истёк, но закупка не отмечена как поданная или завершённая.")),
    )


def application_completeness() -> Column:
    """(ready, missing, invalid_files, stale_evidence) for checklist (text, mandatory, done, file_version, validation)
    and requirements (text, evidence (stale)); a requirement is named once for each stale link."""
    named = lambda name, other: F.when(text(name) == "", other).otherwise(name)
    entries, requirements = F.coalesce("checklist", F.array()), F.coalesce("requirements", F.array())
    missing = F.transform(F.filter(entries, lambda e: e["mandatory"] & ~e["done"]), lambda e: named(e["text"], "Обязательный пункт без названия"))
    invalid = F.transform(F.filter(entries, lambda e: e["done"] & ((text(e["file_version"]) == "") | (F.trim(text(e["validation"])) != ""))), lambda e: named(e["text"], "Пункт заявки"))
    stale = F.flatten(F.transform(requirements, lambda r: F.transform(F.filter(F.coalesce(r["evidence"], F.array()), lambda e: e["stale"]), lambda _: r["text"])))
    ready = (F.size(missing) == 0) & (F.size(invalid) == 0) & (F.size(stale) == 0)
    return F.struct(ready.alias("ready"), missing.alias("missing"), invalid.alias("invalid_files"), stale.alias("stale_evidence"))


def compliance() -> Column:
    """(confirmed, total, gaps, questions) for requirements (text, status, question); a question without a text is
    the requirement's own."""
    every = F.coalesce("requirements", F.array())
    gaps = F.transform(F.filter(every, lambda r: text(r["status"]).isin(GAPS)), lambda r: r["text"])
    asked = F.filter(every, lambda r: (text(r["status"]) == TO_CLARIFY) | (F.trim(text(r["question"])) != ""))
    questions = F.transform(asked, lambda r: F.coalesce(F.nullif(F.trim(text(r["question"])), F.lit("")), r["text"]))
    confirmed = F.size(F.filter(every, lambda r: text(r["status"]) == CONFIRMED))
    return F.struct(confirmed.alias("confirmed"), F.size(every).alias("total"), gaps.alias("gaps"), questions.alias("questions"))


def open_requirements() -> Column:
    """How many requirements (status) aren't confirmed."""
    return F.size(F.filter(F.coalesce("requirements", F.array()), lambda r: text(r["status"]) != CONFIRMED))


def schedule_risks(today: Column) -> Column:
    """Array of messages, each once, for internal_deadline, submission_deadline, status, estimated_hours and
    assignments (role, planned_hours, overload: the first overloaded day, as text, or null)."""
    days = dates.days_to(F.coalesce("internal_deadline", "submission_deadline"), today)
    unready, assigned = ~text(F.col("status")).isin(READY_SCHEDULE), F.coalesce("assignments", F.array())
    planned = F.aggregate(assigned, F.lit(0.0), lambda s, a: s + F.coalesce(a["planned_hours"], F.lit(0.0)))
    loads = F.transform(F.filter(assigned, lambda a: a["overload"].isNotNull()), lambda a: F.concat(F.lit("Перегрузка сотрудника: "), a["overload"]))
    return F.array_distinct(
        F.concat(
            _listed(
                (unready & (days < 0), "Внутренний срок просрочен"),
                (unready & days.between(0, 3), F.concat(F.lit("До внутреннего срока "), days.cast("string"), F.lit(" дн."))),
                (~F.exists(assigned, lambda a: text(a["role"]).isin(MANAGERS)), "Не назначен менеджер"),
                (planned < _number("estimated_hours"), F.concat(F.lit("Не распределено "), plain_number(_number("estimated_hours") - planned), F.lit(" ч."))),
            ),
            loads,
        )
    )


def staff_readiness(today: Column, warning_days: int = 60) -> Column:
    """(met, total, missing, ready) for full_name, role, grade, skills, basis, basis_other, start_date, qualification
    and documents (category, name, type, unlimited, expires)."""

    def held(category: str) -> Column:
        return F.exists(
            F.coalesce("documents", F.array()),
            lambda d: (d["category"] == category) & ((text(d["name"]) != "") | (text(d["type"]) != "")) & ~dates.expiry(d["unlimited"], d["expires"], today, warning_days).isin("expired", "missing"),
        )

    own = F.col("basis") == "Штат"
    checks = [
        ("ФИО", ~_blank("full_name")), ("Должность или роль", ~_blank("role")), ("Грейд", ~_blank("grade")), ("Навыки", F.size(F.coalesce("skills", F.array())) > 0),
        ("Основание сотрудничества", (text(F.col("basis")) != "") & ((F.col("basis") != "Иное") | ~_blank("basis_other"))), ("Дата начала", F.col("start_date").isNotNull()), ("Квалификация", ~_blank("qualification")),
        *[(label, held(category)) for category, label in DOCUMENT_LABELS.items()],
    ]
    wanted = lambda label: ~own if label == DOCUMENT_LABELS["certificate"] else F.lit(True)
    failed = _listed(*[(F.coalesce(wanted(label), F.lit(True)) & ~F.coalesce(met, F.lit(False)), label) for label, met in checks])
    total = F.lit(len(checks)) - F.coalesce(own.cast("int"), F.lit(0))
    return F.struct((total - F.size(failed)).alias("met"), total.alias("total"), failed.alias("missing"), (F.size(failed) == 0).alias("ready"))


def urgent_document(documents: str, today: Column, warning_days: int) -> Column:
    """(expires, at, category) of the document (expires, unlimited, ...) that expires or expired first; `at` is its place
    in the array, ties go to the first."""
    ranked = F.transform(documents, lambda d, i: F.struct(d["expires"].alias("expires"), i.alias("at"), dates.expiry(d["unlimited"], d["expires"], today, warning_days).alias("category")))
    return F.array_min(F.filter(ranked, lambda r: r["category"].isin("expired", "expiring")))


def any_expiry(documents: str, category: str, today: Column, warning_days: int) -> Column:
    """Whether a document is of the category; `no-document` is the category of people without any."""
    if category == "no-document":
        return F.size(F.coalesce(documents, F.array())) == 0
    return F.exists(F.coalesce(documents, F.array()), lambda d: dates.expiry(d["unlimited"], d["expires"], today, warning_days) == category)


def dashboard(today: Column) -> dict[str, Column]:
    """Predicates by name: of procurements (submission_deadline, status), of contracts (payment_status,
    payment_planned, acts_status, stage, end_date)."""
    due, left = dates.days_until(F.col("submission_deadline"), today), dates.days_until(F.col("end_date"), today)
    return {
        "deadline": due.between(0, 7) & ~text(F.col("status")).isin(CLOSED_PROCUREMENT),
        "overdue": (text(F.col("payment_status")) == "Просрочено") | ((F.col("payment_planned") < today) & ~text(F.col("payment_status")).isin(PAID_OR_NONE)),
        "unsigned_acts": ~text(F.col("acts_status")).isin(ACTS_DONE) & text(F.col("stage")).isin(WORK_DONE),
        "ending": left.between(0, 30),
    }


def complexity(level: Column) -> Column:
    """(points, hours, least_experience) of a complexity; null for other values."""
    named = lambda i: F.create_map(*[F.lit(x) for level, row in COMPLEXITY.items() for x in (level, row[i])])[level]
    return F.struct(named(0).alias("points"), named(1).alias("hours"), named(2).alias("least_experience"))


def email_state(value: Column, stored: Column | None = None) -> Column:
    """`ok`, `error`, or `warning` for a wrong address that is stored already."""
    trimmed = F.trim(text(value))
    fine = (trimmed == "") | trimmed.rlike(EMAIL)
    legacy = F.lit(False) if stored is None else F.coalesce(value == stored, F.lit(False))
    return F.when(fine, "ok").when(legacy, "warning").otherwise("error")


def nested_counts(df: DataFrame, array: str, rows: str, rows_with: str) -> DataFrame:
    """(rows, `array`, rows_with): how many rows there are, entries in all of their arrays, and rows with any."""
    n = F.coalesce(F.size(array), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return df.agg(F.count("*").alias(rows), F.coalesce(F.sum(n), F.lit(0)).alias(array), F.count_if(n > 0).alias(rows_with))


def calendar_stats(schedules: DataFrame, loads: DataFrame, today: Column, least: int = 5) -> DataFrame:
    """(active, urgent, without_manager, overloaded): schedules (status, internal_deadline, submission_deadline, roles) that
    are neither submitted nor paused, those of them due in `least` days or overdue, and without a manager; people of
    loads (load_percent, conflicts) with more than they can do, or with conflicts."""
    active = ~text(F.col("status")).isin(SUBMITTED_OR_PAUSED)
    left = F.datediff(F.coalesce("internal_deadline", "submission_deadline"), today)
    managed = F.exists(F.coalesce(F.col("roles"), F.array().cast("array<string>")), lambda r: r.isin(MANAGERS))
    own = schedules.agg(F.count_if(active).alias("active"), F.count_if(active & (left <= least)).alias("urgent"), F.count_if(active & ~managed).alias("without_manager"))
    over = loads.agg(F.count_if((F.col("load_percent") > 100) | (F.col("conflicts") > 0)).alias("overloaded"))
    # a row each
    return own.join(F.broadcast(over), F.lit(True))


def actual_result(final_price: Column, costs: Column) -> Column:
    """(profit, margin) of a procedure that has ended."""
    profit = final_price - costs
    return F.struct(profit.alias("profit"), F.when(F.coalesce(final_price, F.lit(0.0)) != 0, profit / F.nullif(final_price, F.lit(0.0)) * 100).otherwise(0.0).alias("margin"))


def _first_that_holds(*rules: tuple[Column, str | None]) -> Column:
    found = F.lit(None).cast("string")
    for holds, says in reversed(rules):
        found = F.when(F.coalesce(holds, F.lit(False)), F.lit(says)).otherwise(found)
    return found


def provider_error(mode: Column, endpoint: Column, redirects: Column, timeout: Column, jobs: Column, secret: Column, fingerprint: Column) -> Column:
    """Why a provider may not be used so (null: it may). mode is disabled, same-computer or local-network."""
    here, near = mode == "same-computer", mode == "local-network"
    return _first_that_holds(
        (redirects, PROVIDER["redirects"]), (~F.coalesce(timeout.between(5, 600), F.lit(False)), PROVIDER["timeout"]), (~F.coalesce(jobs.between(1, 4), F.lit(False)), PROVIDER["jobs"]),
        (endpoint.isNull() & (mode == "disabled"), None), (endpoint.isNull(), PROVIDER["no-address"]), (endpoint.contains("@") | endpoint.contains("#"), PROVIDER["credentials"]),
        (mode == "disabled", PROVIDER["disabled"]), (here & ~endpoint.rlike("^(unix|npipe)://"), PROVIDER["socket"]), (near & ~endpoint.startswith("https://"), PROVIDER["https"]),
        (near & (text(secret) == ""), PROVIDER["secret"]), (near & (text(fingerprint) == ""), PROVIDER["certificate"]),
    )


def next_job_status(status: Column, cancel: bool) -> Column:
    """Status after recovery (running jobs are interrupted) or a cancellation; cancelling what has ended raises."""
    if not cancel:
        return F.when(status == "running", "interrupted").otherwise(status)
    open_job = status.isin("queued", "running", "interrupted")
    return F.when(open_job, "cancelled").otherwise(F.raise_error(F.concat(F.lit("a job cannot be cancelled when "), text(status))))


def render_budget(pages: Column, width_pt: Column, height_pt: Column, dpi: Column, size: Column, most_pages: int = 5_000, most_pixels: float = 180e6, most_bytes: int = 1 << 30) -> Column:
    """What of a document is beyond the limits: `size`, `pages`, `pixels` (of a page of points at a resolution)."""
    pixels = (width_pt / 72 * dpi) * (height_pt / 72 * dpi)
    return _listed(((size < 1) | (size > most_bytes), "size"), ((pages < 1) | (pages > most_pages), "pages"), (pixels > most_pixels, "pixels"))


def savings_percent(original: Column, output: Column) -> Column:
    return (1 - output / F.greatest(F.lit(1), original)) * 100


def word_confidence(words: str, keep: float = 20.0, low: float = 50.0, most: int = 200) -> Column:
    """(mean, low) of words (text, confidence): those below `keep` don't count; the first `most` below `low` are listed."""
    kept = F.filter(words, lambda w: w["confidence"] >= keep)
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, w: s + w["confidence"]) / F.size(kept)).otherwise(0.0)
    return F.struct(mean.alias("mean"), F.slice(F.transform(F.filter(kept, lambda w: w["confidence"] < low), lambda w: w["text"]), 1, most).alias("low"))
