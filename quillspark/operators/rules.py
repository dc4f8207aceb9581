"""Rules kept as tables: severities of gates and priorities of files, read when a job is set up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

MOST_RULES = 1000
ANY = "*"
SEVERITIES = ("FAIL", "WARN")


def rule_rows(rules: DataFrame, *columns: str) -> list[Row]:
    """The rules of a table. They become part of the plan, so a table of more than MOST_RULES is refused."""
    rows = rules.select(*columns).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return rows


def table_status(rules: list[Row], gate: str, status: Column, template: Column) -> Column:
    """Status of a gate after the severity table: its failures become what the table says for the template.

    Rows for template ``*`` hold for all templates the gate has no row of its own for. Gates the table
    does not name keep their status. Two rows for one gate and template, and severities other than FAIL and WARN, are errors.
    """
    named: dict[str, str] = {}
    for rule in rules:
        if rule["severity"] not in SEVERITIES:
            raise ValueError(f"unknown severity {rule['severity']!r} of gate {rule['gate']!r}")
        if rule["gate"] == gate:
            if rule["template"] in named:
                raise ValueError(f"two severities for gate {gate!r} and template {rule['template']!r}")
            named[rule["template"]] = rule["severity"]
    chosen = F.lit(named.get(ANY, "FAIL"))
    for name, severity in sorted(named.items()):
        if name != ANY:
            chosen = F.when(template == name, severity).otherwise(chosen)
    return F.when(status == "FAIL", chosen).otherwise(status)


def file_rules(rules: DataFrame) -> list[tuple[list[str], int, str]]:
    """Rules for ``classify.file_priority`` from a table of ``place, keyword, priority, category``, one row per keyword.

    Places give the order; a keyword counts in lower case. Rows of equal place follow the keyword's order.
    """
    rows = sorted(rule_rows(rules, "place", "keyword", "priority", "category"), key=lambda r: (r["place"], r["keyword"]))
    return [([r["keyword"].lower()], r["priority"], r["category"]) for r in rows]
