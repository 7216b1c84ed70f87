"""Positional arguments of queued commands, checked as columns."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The arguments that each command takes, optional ones in brackets, and the forms of names.
SIGNATURES = {
    "train_folds": "run config scheme map buffer [seed]",
    "score_view": "run scheme map gate",
    "record": "id run config hypothesis notes",
    "gate": "name incumbent gate config hypothesis",
    "endpoint_view": "base run scheme",
    "curved_view": "base run scheme",
    "rival_threshold": "run scheme map expected [factor]",
    "compare_seed": "incumbent gate incumbent_runs candidate_runs [notes]",
    "compare_schedule": "incumbent gate incumbent_runs candidate_runs [notes]",
}
SCHEMES = ("spatial", "fault", "trace")
GATE_NAME = r"^CAND-[A-Z0-9_]+-(B16|B32|TRACE)$|^ENDPOINT-EXT-[0-9]+$"
GATE_DIR, RUN_DIR = "runs/gate/", "runs/"
CANDIDATE_CONFIG = "configs/candidates/cand_%s.yaml"


def calls(tasks: DataFrame, signatures: dict[str, str] = SIGNATURES) -> DataFrame:
    """id, part, command, n, least, most, args (name to value), escaped and unparsed: a row for each known command that && chains.

    Words are split as a shell does, in Arrow batches. A part that cannot be split has unparsed alone; a null command has no parts.
    """
    table = {k: (v.replace("[", "").replace("]", "").split(), sum(not x.startswith("[") for x in v.split())) for k, v in signatures.items()}

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for task, cmd in zip(b["id"], b["cmd"]):
                for part, text in enumerate((cmd or "").split("&&")):
                    escaped = '\\"' in text
                    try:
                        words = shlex.split(text.replace('\\"', '"'))
                    except ValueError:
                        rows.append((task, part, None, None, None, None, {}, escaped, True))
                        continue
                    name = words[0].rsplit("/", 1)[-1].removesuffix(".sh") if words else ""
                    if name in table:
                        names, least = table[name]
                        rows.append((task, part, name, len(words) - 1, least, len(names), dict(zip(names, words[1:])), escaped, False))
                    elif escaped:
                        rows.append((task, part, None, None, None, None, {}, True, False))
            yield pd.DataFrame(rows, columns=["id", "part", "command", "n", "least", "most", "args", "escaped", "unparsed"])

    schema = "id string, part int, command string, n int, least int, most int, args map<string,string>, escaped boolean, unparsed boolean"
    return tasks.select(F.col("id").cast("string").alias("id"), "cmd").mapInPandas(split, schema)


def _base(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def command_findings(tasks: DataFrame, maps: dict[str, str], config: str | None = None, signatures: dict[str, str] = SIGNATURES) -> DataFrame:
    """id, part, command, kind of each argument that breaks its command's contract. ``tasks``: id, cmd.

    ``maps`` is the current fold map of each scheme; ``config`` what runs named ref-cv-... must use. Commands of the
    wrong number of arguments, an unknown scheme or gate name get that finding and no other from their arguments. A
    missing optional argument is not checked. Tasks without a known command have no rows; ``unchecked`` gives them.
    """
    arg = lambda name: F.try_element_at("args", F.lit(name))
    run, scheme, buffer, name, gate = _base(arg("run")), arg("scheme"), arg("buffer"), arg("name"), arg("gate")
    current = F.create_map(*[F.lit(x) for pair in maps.items() for x in pair])
    counted = F.col("n").between(F.col("least"), F.col("most"))
    known = counted & (scheme.isNull() | scheme.isin(*SCHEMES)) & (name.isNull() | name.rlike(GATE_NAME))
    suffix = lambda base: F.regexp_extract(base, r"-b([0-9]+)(-|$)", 1)
    off_scheme = lambda base: ~(F.contains(base, F.concat(F.lit("-"), scheme, F.lit("-"))) | F.endswith(base, F.concat(F.lit("-"), scheme)))
    number = lambda x: arg(x).try_cast("double")
    slug = lambda base: F.regexp_extract(base, "^cand-([^-]*)", 1)
    candidate = _base(gate)
    own = F.coalesce(run, candidate)
    want = F.when(own.startswith("cand-"), F.format_string(CANDIDATE_CONFIG, slug(own))).when(own.startswith("ref-cv-") & run.isNotNull(), F.lit(config))
    named = F.lower(F.regexp_extract(name, "^CAND-(.*)-[^-]*$", 1))
    wide = F.lower(F.regexp_extract(name, "-(B16|B32)$", 1))
    first = F.split(F.regexp_replace(candidate, "^cand-", ""), "-")[0]
    strange = name.startswith("CAND-") & ((~F.contains(candidate, named) & ~F.contains(named, first)) | ((wide != "") & (suffix(candidate) != "") & (F.concat(F.lit("b"), suffix(candidate)) != wide)))
    outside = lambda x, where: ~arg(x).startswith(where)
    good_buffer = buffer.rlike("^[0-9]*[1-9][0-9]*$")
    checks = [
        (F.col("escaped"), "ESCAPED-QUOTE"),
        (F.col("unparsed"), "ARG-PARSE-ERROR"),
        (~counted, "ARG-COUNT"),
        (counted & ~scheme.isin(*SCHEMES), "BAD-SCHEME"),
        (counted & ~name.rlike(GATE_NAME), "BAD-GATE-NAME"),
        (known & (arg("map") != F.try_element_at(current, scheme)), "STALE-FOLD-MAP"),
        (known & (off_scheme(run) | F.coalesce(off_scheme(_base(arg("base"))), F.lit(False))), "SCHEME-DIR-MISMATCH"),
        (known & (arg("config") != want), "CONFIG-DIR-MISMATCH"),
        (known & ~good_buffer, "BAD-BUFFER"),
        (known & good_buffer & (suffix(run) != "") & (suffix(run).try_cast("long") != buffer.try_cast("long")), "BUFFER-SUFFIX-MISMATCH"),
        (known & ~arg("seed").rlike("^[0-9]{8}$"), "BAD-SEED"),
        (known & (arg("id") != run), "RECORD-ID-MISMATCH"),
        (known & (outside("gate", GATE_DIR) | F.coalesce(outside("incumbent", GATE_DIR), F.lit(False)) | F.coalesce(outside("incumbent_runs", RUN_DIR), F.lit(False)) | F.coalesce(outside("candidate_runs", RUN_DIR), F.lit(False))), "BAD-GATE-DIR"),
        (known & strange, "GATE-DIR-MISMATCH"),
        (known & arg("expected").isNotNull() & ~F.coalesce((number("expected") > 0) & (number("expected") < 1), F.lit(False)), "BAD-EXPECTED-SCORE"),
        (known & arg("factor").isNotNull() & ~F.coalesce((number("factor") > 0) & ~F.isnan(number("factor")), F.lit(False)), "BAD-EXPECTED-SCORE"),
    ]
    kinds = F.array_compact(F.array(*[F.when(ok, F.lit(kind)) for ok, kind in checks]))
    return calls(tasks, signatures).select("id", "part", "command", F.explode(kinds).alias("kind"))


def unchecked(tasks: DataFrame, signatures: dict[str, str] = SIGNATURES) -> DataFrame:
    """id of the tasks that name no known command."""
    seen = calls(tasks, signatures).where("command is not null").select("id")
    return tasks.select(F.col("id").cast("string").alias("id")).join(seen, "id", "left_anti")
