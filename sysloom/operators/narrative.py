"""Digests of a run for a reviewer (person or model), and the merge of answers.

Digests are tables of lines ordered by their order columns; nothing is gathered
per run before the prompt texts, which hold a fixed number of lines each.  No model is
called here: answers come in as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import packs
from ..schemas import FINDING_TYPE
from ..session import cut_lineage
from .numbering import in_parts
from .telemetry import filter_events

PROCESS_LINES, FILE_LINES = 30, 50
#: Digest lines of one prompt; a run with more has several prompts.
PROMPT_LINES = 2_000
NO_FINDINGS = "  (no findings from rule engine)"
METHOD_RULES = "rules"
METHOD_MODEL = "hybrid (rules + LLM)"
METHOD_CHAIN = "hybrid (rules + LLM attack chain)"
METHOD_ERROR = "rules only (LLM error: {})"


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _first_n(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each run by seq (kept to n per task before the shuffle)."""
    order = Window.partitionBy("detonation_id").orderBy("seq")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def distinct_processes(events: DataFrame) -> DataFrame:
    return filter_events(events, "EXECVE").groupBy("detonation_id", "process_name", "filename").agg(
        F.min_by("pid", "seq").alias("pid"), F.min("seq").alias("seq"))


def process_digest(events: DataFrame, n: int = PROCESS_LINES) -> DataFrame:
    c = F.col
    line = _line("  - ", c("process_name"), " executed: ", c("filename"), " (PID=", c("pid"), ")")
    return _first_n(distinct_processes(events), n).select("detonation_id", "position", "seq", line.alias("line"))


def distinct_files(events: DataFrame) -> DataFrame:
    """Opened files outside the install paths, with the first process that opened each."""
    opens = filter_events(events, "OPENAT").filter(~fx.is_safe_path("filename", packs.DIGEST_SAFE_PREFIXES))
    by_process = opens.groupBy("detonation_id", "filename", "process_name").agg(F.min("seq").alias("seq"))
    return by_process.groupBy("detonation_id", "filename").agg(
        F.min_by("process_name", "seq").alias("process_name"), F.min("seq").alias("seq"))


def file_digest(events: DataFrame, n: int = FILE_LINES) -> DataFrame:
    """The first n lines; ``unique_files`` counts all of them."""
    files = distinct_files(events)
    total = files.groupBy("detonation_id").agg(F.count("*").alias("unique_files"))
    line = _line("  - ", F.col("process_name"), " accessed: ", F.col("filename"))
    first = _first_n(files, n).select("detonation_id", "position", "seq", line.alias("line"))
    return first.join(total, "detonation_id")


def connection_digest(events: DataFrame) -> DataFrame:
    line = _line("  - ", F.col("process_name"), " → ", fx.ipv4("connect_ip"), ":", F.col("connect_port"))
    return filter_events(events, "CONNECT").select("detonation_id", "seq", line.alias("line"))


def deletion_digest(events: DataFrame) -> DataFrame:
    line = _line("  - ", F.col("process_name"), " deleted: ", F.col("filename"))
    return filter_events(events, "UNLINK").filter(F.col("filename") != "").select("detonation_id", "seq", line.alias("line"))


def finding_digest(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One line per finding; runs without any get a placeholder line."""
    c = F.col
    line = _line("  - [", c("severity"), "] [", c("mitre_id"), "] ", c("description"), ": ", c("evidence"))
    order = ["severity_rank", "phase", "order_key", "ordinal"]
    lines = findings.select("detonation_id", *order, line.alias("line"))
    none = verdicts.filter(F.col("finding_count") == 0).select(
        "detonation_id", *[F.lit(0).cast(t).alias(n) for n, t in zip(order, ("int", "int", "long", "long"))],
        F.lit(NO_FINDINGS).alias("line"))
    return lines.unionByName(none)


# ---------------------------------------------------------------- prompts
ANSWER_SHAPE = (
    'Answer with one JSON object: {"threat_score": 0-100, "risk_level": "SAFE|SUSPICIOUS|MALICIOUS", "findings": '
    '[{"severity", "category", "description", "evidence", "mitre_id"}], "recommendation": text}. Severities: '
    + ", ".join(packs.SEVERITIES[:4]) + ". Categories: " + ", ".join(packs.CATEGORIES) + ".")
CHAIN_SHAPE = ('Answer with one JSON object: {"executive_summary": two or three sentences, '
               '"attack_chain": ["Stage 1 ...", "Stage 2 ..."]}.')

_FINDINGS, _PROCESSES, _FILES, _CONNECTIONS, _DELETIONS = range(5)
_LINE_ORDER = ("section", "rank", "phase", "key", "ordinal", "line")


def _sections(events: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Digest lines with (section, order...) ahead of the text."""
    def rows(lines: DataFrame, section: int, rank=F.lit(0), phase=F.lit(0), key="seq", ordinal=F.lit(0)) -> DataFrame:
        return lines.select("detonation_id", F.lit(section).alias("section"), rank.cast("int").alias("rank"),
                            phase.cast("int").alias("phase"), F.col(key).cast("long").alias("key"),
                            ordinal.cast("long").alias("ordinal"), "line")

    c = F.col
    found = finding_digest(findings, verdicts)
    return (
        rows(found, _FINDINGS, c("severity_rank"), c("phase"), "order_key", c("ordinal"))
        .unionByName(rows(process_digest(events), _PROCESSES)).unionByName(rows(file_digest(events), _FILES))
        .unionByName(rows(connection_digest(events), _CONNECTIONS)).unionByName(rows(deletion_digest(events), _DELETIONS)))


def _prompts(events: DataFrame, findings: DataFrame, routed: DataFrame, head: Column, sections: list[tuple[Column, str]],
             tail: Column, limit: int) -> DataFrame:
    """(detonation_id, part_no, prompt): the next ``limit`` digest lines of a run between
    heading, number of the part, the titles of all sections, and the task.

    A section without lines in the whole run says so; one whose lines are in other parts has its title only.
    """
    ids = routed.select("detonation_id")
    used = ("detonation_id", "seq", "event_type", "process_name", "filename", "pid", "connect_ip", "connect_port")
    # the events of the routed runs are read once for all digests
    mine = cut_lineage(events.filter(F.col("event_type").isin("EXECVE", "OPENAT", "CONNECT", "UNLINK")).select(*used).join(ids, "detonation_id", "left_semi"))
    lines = _sections(mine, findings.join(ids, "detonation_id", "left_semi"), routed)
    tallies = {f"_total{k}": F.col("section") == k for k in range(len(sections))}
    parts = in_parts(lines, ["detonation_id"], _LINE_ORDER, limit, F.struct("section", "line"), tallies)
    files = distinct_files(mine).groupBy("detonation_id").agg(F.count("*").alias("unique_files"))
    rows = routed.join(parts, "detonation_id").join(files, "detonation_id", "left").withColumn("unique_files", F.coalesce("unique_files", F.lit(0)))

    def section(k: int, title: Column, none: str) -> Column:
        own = F.transform(F.filter("rows", lambda r: r["section"] == k), lambda r: r["line"])
        text = F.when(F.col(f"_total{k}") == 0, F.lit(none)).when(F.size(own) > 0, F.array_join(own, "\n"))
        return F.concat_ws("\n", title, text)

    of = _line("Part ", F.col("part_no") + 1, " of ", F.ceil(F.col("rows_total") / limit))
    text = F.concat_ws("\n", head, of, *[section(k, title, none) for k, (title, none) in enumerate(sections)], tail)
    return rows.select("detonation_id", "part_no", text.alias("prompt"))


def analysis_prompts(events: DataFrame, findings: DataFrame, verdicts: DataFrame, limit: int = PROMPT_LINES) -> DataFrame:
    """Prompts for the ambiguous runs (route ``llm``)."""
    routed = verdicts.filter(fx.triage_route("threat_score") == "llm")
    c = F.col
    head = _line(
        "Judge an npm package by what its installation did in a sandbox.\nPackage: ", c("package_name"), "\nRun: ",
        c("detonation_id"), "\nEvents: ", c("events_analyzed"), " (EXECVE ", c("execve_count"), ", OPENAT ", c("openat_count"),
        ", CONNECT ", c("connect_count"), ", WRITE ", c("write_count"), ", UNLINK ", c("unlink_count"), ")\nRule score: ",
        c("threat_score"), "/100")
    sections = [
        (F.lit("# Findings of the rules"), NO_FINDINGS),
        (_line("# Processes started (", c("execve_count"), " in total)"), "  (none beyond npm and node)"),
        (_line("# Files opened outside the install paths (", c("unique_files"), " unique)"), "  (none beyond the install paths)"),
        (F.lit("# Connections"), "  (none)"), (F.lit("# Deleted files"), "  (none)")]
    return _prompts(events, findings, routed, head, sections, F.lit(ANSWER_SHAPE), limit)


def attack_chain_prompts(events: DataFrame, findings: DataFrame, verdicts: DataFrame, limit: int = PROMPT_LINES) -> DataFrame:
    """Prompts for the narrative of malicious runs; they add the write count."""
    routed = verdicts.filter(F.col("threat_score") >= packs.MALICIOUS_FROM)
    head = _line("Reconstruct the attack carried out by a malicious npm package.\nPackage: ", F.col("package_name"),
                 "\nThreat score: ", F.col("threat_score"), "/100")
    titles = ("# Findings of the rules", "# Processes started", "# Files opened outside the install paths", "# Connections", "# Deleted files")
    sections = [(F.lit(t), NO_FINDINGS if k == _FINDINGS else "  (none)") for k, t in enumerate(titles)]
    tail = _line("# Writes: ", F.col("write_count"), "\n" + CHAIN_SHAPE)
    return _prompts(events, findings, routed, head, sections, tail, limit)


# ---------------------------------------------------------------- answers
_FINDING = "array<struct<severity:string,category:string,description:string,evidence:string,mitre_id:string>>"
ANSWER_SCHEMA = f"threat_score long, risk_level string, findings {_FINDING}, recommendation string, _bad string"
CHAIN_SCHEMA = "executive_summary string, attack_chain array<string>, _bad string"


def strip_fence(text: Column) -> Column:
    """Answer text without a surrounding ``` fence."""
    text = fx.strip_ws(text)
    lines = F.split(text, "\n")
    closed = fx.strip_ws(F.element_at(lines, -1)) == "```"
    keep = F.greatest(F.size(lines) - 1 - closed.cast("int"), F.lit(0))
    return F.when(text.startswith("```"), F.array_join(F.slice(lines, F.lit(2), keep), "\n")).otherwise(text)


def _parse(responses: DataFrame, schema: str) -> DataFrame:
    """Fields of the answers; an answer that is no JSON object, or has a field of
    the wrong type, is not ``parsed``."""
    texts = responses.select("detonation_id", fx.once(strip_fence(F.col("response"))).alias("text"))
    rows = fx.parse_json(texts, "text", schema, ["detonation_id", "text"])
    ok = F.col("_bad").isNull() & F.col("text").startswith("{")
    return rows.withColumn("parsed", F.coalesce(ok, F.lit(False))).drop("text", "_bad")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Answers as columns, ``parsed`` tells the failures."""
    rows = _parse(responses, ANSWER_SCHEMA)
    value = lambda f: F.when(F.col("parsed"), F.col(f))
    return rows.select("detonation_id", "parsed", *[value(f).alias(f) for f in ("threat_score", "risk_level", "recommendation", "findings")])


def valid_findings(findings: Column) -> Column:
    """Defaults for missing fields; findings with an unknown severity or category are dropped."""
    full = F.transform(F.coalesce(findings, F.array().cast(_FINDING)), lambda f: F.struct(
        F.coalesce(f["severity"], F.lit("MEDIUM")).alias("severity"),
        F.coalesce(f["category"], F.lit("suspicious_activity")).alias("category"),
        *[F.coalesce(f[n], F.lit("")).alias(n) for n in ("description", "evidence", "mitre_id")], F.lit("").alias("mitre_name")))
    return F.filter(full, lambda f: f["severity"].isin(*packs.SEVERITIES) & f["category"].isin(*packs.CATEGORIES)).cast(
        FINDING_TYPE.simpleString().join(("array<", ">")))


def one_answer(responses: DataFrame, order: str | None = None) -> DataFrame:
    """The last answer of each run by ``order``; the greatest text among equals, or without an order."""
    rank = F.struct(*([order] if order else []), "response")
    return responses.groupBy("detonation_id").agg(F.max_by("response", rank).alias("response"))


def merge_responses(verdicts: DataFrame, responses: DataFrame, order: str | None = None) -> DataFrame:
    """Refine the ambiguous verdicts by their answers.

    A parsed answer replaces score, risk, recommendation and findings
    (``model_findings``); a missing or failed one keeps the rule verdict and
    says so.  Verdicts outside the ambiguous band pass unchanged.
    """
    answers = parse_responses(one_answer(responses, order)).select(
        "detonation_id", "parsed", F.col("threat_score").alias("_score"), F.col("risk_level").alias("_risk"),
        F.col("recommendation").alias("_advice"), F.col("findings").alias("_findings"))
    joined = verdicts.join(answers, "detonation_id", "left")
    asked = fx.triage_route("threat_score") == "llm"
    use = asked & F.coalesce("parsed", F.lit(False))
    risk = F.upper("_risk")
    risk = F.when(risk.isin(*packs.RISK_LEVELS), risk).otherwise("SUSPICIOUS")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("_score", "threat_score"))).cast("long")
    reason = F.when(F.col("parsed").isNull(), METHOD_ERROR.format("no answer")).otherwise(METHOD_ERROR.format("invalid answer"))
    out = joined.select(
        *[c for c in verdicts.columns if c not in ("threat_score", "risk_level", "recommendation", "analysis_method", "finding_count")],
        F.when(use, score).otherwise(F.col("threat_score")).alias("threat_score"),
        F.when(use, risk).otherwise(F.col("risk_level")).alias("risk_level"),
        F.when(use, F.coalesce("_advice", "recommendation")).otherwise(F.col("recommendation")).alias("recommendation"),
        F.when(use, METHOD_MODEL).when(asked, reason).otherwise(F.col("analysis_method")).alias("analysis_method"),
        F.when(use, valid_findings(F.col("_findings"))).alias("model_findings"), F.col("finding_count").alias("_rule_count"))
    count = F.when(F.col("model_findings").isNotNull(), F.size("model_findings")).otherwise(F.col("_rule_count"))
    return out.withColumn("finding_count", count.cast("long")).drop("_rule_count")


def merge_attack_chains(verdicts: DataFrame, responses: DataFrame, order: str | None = None) -> DataFrame:
    """Attach summary and stages to malicious verdicts; score and findings stay."""
    rows = _parse(one_answer(responses, order), CHAIN_SCHEMA).filter("parsed").select(
        "detonation_id", F.lit(True).alias("_has"), F.col("executive_summary").alias("_summary"),
        F.col("attack_chain").alias("_chain"))
    joined = verdicts.join(rows, "detonation_id", "left")
    use = (F.col("threat_score") >= packs.MALICIOUS_FROM) & F.coalesce("_has", F.lit(False))
    none = F.array().cast("array<string>")
    return (
        joined.withColumn("executive_summary", F.when(use, F.coalesce("_summary", F.lit(""))).otherwise(""))
        .withColumn("attack_chain", F.when(use, F.coalesce("_chain", none)).otherwise(none))
        .withColumn("analysis_method", F.when(use, METHOD_CHAIN).otherwise(F.col("analysis_method")))
        .drop("_has", "_summary", "_chain"))


def triage_route(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("detonation_id", "threat_score", fx.triage_route("threat_score").alias("route"),
                           (F.col("threat_score") >= packs.MALICIOUS_FROM).alias("attack_chain"))


