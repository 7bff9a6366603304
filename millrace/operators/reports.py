"""HTML texts of procurement reports, from lists inside of a record, in the JVM.

Rows of a table are the entries of an array, in its order; where the rows are a table of their own, `listed` gathers them
by record in the order asked for. A record's report is one text, so a record should have as many entries as a reader
would look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import js_round
from millrace.functions.text import escape_html, rubles, text

# Headings and texts of the reports.
WORK, WORK_HEAD, NO_PARTNERS, TOTAL, OVER = "Распределение работ", ("Участник", "Роль", "Доля, %", "Зона ответственности"), "Партнёры не добавлены.", "Итого", "Доля превышает 100%"
MATRIX, MATRIX_HEAD, SUMMARY, CHECKLIST, GAPS = "Матрица соответствия", ("Требование", "Источник", "Подтверждение", "Статус"), "Сводка", "Чек-лист подачи", "Пробелы и вопросы"
SITE, DUE, STATUS, CONFIRMED, UNCLEAR = "Площадка", "Срок подачи", "Статус", "Подтверждено", "Требует уточнения"
PROCUREMENT, CUSTOMER, SUBJECT, START_PRICE = "Закупка", "Заказчик", "Предмет", "НМЦ"


def listed(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """(key, name): the fields of each record's rows as an array of structs, in order."""
    each = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], *fields)))
    return rows.groupBy(key).agg(F.transform(each, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def joined(entries: Column, shown) -> Column:
    return F.array_join(F.transform(F.coalesce(entries, F.array()), shown), "")


def _tag(name: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(f"</{name.split()[0]}>"))


def html_table(entries: Column, head: tuple[str, ...], cells, empty: str | None = None, last: Column | str = "") -> Column:
    """A table with a row for each entry; cells(entry) are the texts of its cells. `empty` is shown where there is none."""
    heading = "<tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>"
    rows = joined(entries, lambda x: _tag("tr", *[_tag("td", escape_html(c.cast("string"))) for c in cells(x)]))
    if empty is not None:
        rows = F.when(rows == "", F.lit(f'<tr><td colspan="{len(head)}">{empty}</td></tr>')).otherwise(rows)
    return _tag("table", heading, rows, last)


def whole(value: Column) -> Column:
    """A number as it is written: whole ones without decimals."""
    return F.when(value == js_round(value), js_round(value).cast("string")).otherwise(value.cast("string"))


def work_allocation(partners: Column) -> Column:
    """Who does what: partners (name, role, work_share, responsibility), with the sum of shares and a warning above 100."""
    total = F.aggregate(F.coalesce(partners, F.array()), F.lit(0.0), lambda s, p: s + F.coalesce(p["work_share"].cast("double"), F.lit(0.0)))
    warning = F.when(total > 100, f'<span class="warn">{OVER}</span>').otherwise("")
    last = F.concat(F.lit(f'<tr><td colspan="2"><b>{TOTAL}</b></td><td><b>'), whole(total), F.lit("%</b></td><td>"), warning, F.lit("</td></tr>"))
    return F.concat(F.lit(f"<h2>{WORK}</h2>"), html_table(partners, WORK_HEAD, lambda p: [p["name"], p["role"], whole(p["work_share"].cast("double")), p["responsibility"]], NO_PARTNERS, last))


def summary(platform: Column, deadline: Column, status: Column, requirements: Column, checklist: Column) -> Column:
    """State of a procurement: requirements (text, evidence_kind, evidence, status, question), checklist (text, done,
    responsible); what isn't confirmed, and what is to be asked."""
    line = lambda name, value, end="": F.concat(F.lit(f"<b>{name}:</b> "), escape_html(value), F.lit(end))
    top = _tag("p", line(SITE, platform, "<br>"), line(DUE, deadline, "<br>"), line(STATUS, status))
    matrix = html_table(requirements, MATRIX_HEAD, lambda r: [r["text"], r["evidence_kind"], r["evidence"], r["status"]])
    tasks = joined(checklist, lambda c: _tag("li", F.when(F.coalesce(c["done"], F.lit(False)), "☑ ").otherwise("☐ "), escape_html(c["text"]), " — ", escape_html(c["responsible"])))
    gaps = joined(F.filter(requirements, lambda r: text(r["status"]) != CONFIRMED), lambda r: F.concat(F.lit('<li class="warn">'), escape_html(r["text"]), F.lit(": "), escape_html(r["status"]), F.lit("</li>")))
    asked = joined(F.filter(requirements, lambda r: (text(r["status"]) == UNCLEAR) | (F.trim(text(r["question"])) != "")), lambda r: _tag("li", escape_html(F.when(text(r["question"]) != "", r["question"]).otherwise(r["text"]))))
    return F.concat(F.lit(f"<h2>{SUMMARY}</h2>"), top, F.lit(f"<h2>{MATRIX}</h2>"), matrix, F.lit(f"<h2>{CHECKLIST}</h2>"), _tag("ul", tasks), F.lit(f"<h2>{GAPS}</h2>"), _tag("ul", gaps, asked))


def document(title: Column, name: Column, customer: Column, subject: Column, price: Column, body: Column, style: str = "") -> Column:
    """A whole page around a body."""
    line = lambda label, value, end="": F.concat(F.lit(f"<b>{label}:</b> "), value, F.lit(end))
    about = _tag("p", line(PROCUREMENT, escape_html(name), "<br>"), line(CUSTOMER, escape_html(customer), "<br>"), line(SUBJECT, escape_html(subject), "<br>"), line(START_PRICE, rubles(price)))
    return F.concat(F.lit('<!doctype html><html lang="ru"><meta charset="utf-8">'), _tag("title", escape_html(title)), F.lit(f"<style>{style}</style>"), _tag("h1", escape_html(title)), about, body, F.lit("</html>"))
