"""Outputs: tables, a reproducible sample with its manifest, and small Markdown reports."""

from __future__ import annotations

import gzip
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import account_key, bank_number
from .raw import ACCOUNT_COLUMNS, TRANSACTION_COLUMNS


def stratified_sample(transactions: DataFrame, target: int = 100_000, touching: int = 40_000, seed: str = "sample") -> DataFrame:
    """All laundering rows, then rows that touch a labelled account, then others, each part the first by MD5 up to its quota."""
    h = F.md5(F.concat_ws("|", *TRANSACTION_COLUMNS, F.lit(seed)).cast("binary"))
    sender, receiver = account_key(bank_number(F.col("from_bank")), F.col("from_account")), account_key(bank_number(F.col("to_bank")), F.col("to_account"))
    t = transactions.select(*TRANSACTION_COLUMNS, h.alias("h"), sender.alias("a"), receiver.alias("b"))
    hot = t.filter("is_laundering = '1'").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bad, rest = t.filter("is_laundering = '1'"), t.filter("is_laundering = '0'")
    near = rest.join(hot.select(F.col("id").alias("a")), "a", "left_semi").unionByName(rest.join(hot.select(F.col("id").alias("a")), "a", "left_anti").join(hot.select(F.col("id").alias("b")), "b", "left_semi").select(rest.columns))
    far = rest.join(hot.select(F.col("id").alias("a")), "a", "left_anti").join(hot.select(F.col("id").alias("b")), "b", "left_anti").select(rest.columns)
    n = bad.count()
    quota = min(touching, max(0, target - n))
    return bad.unionByName(near.orderBy("h").limit(quota)).unionByName(far.orderBy("h").limit(max(0, target - n - quota))).select(*TRANSACTION_COLUMNS, "h")


def _write_gz(path: Path, header: str, lines: list[str]) -> str:
    """A gzip file with equal bytes on every run, and its SHA-256."""
    with path.open("wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") as f:
        f.write(("\n".join([*([header] if header else []), *lines]) + "\n").encode())
    return hashlib.sha256(path.read_bytes()).hexdigest()


def write_sample(sample: DataFrame, folder: str, header: str, accounts: DataFrame | None = None, account_header: str = "", pattern_lines: list[str] | None = None, name: str = "HI-Small") -> dict:
    """The sample (its size is the caller's target) as files that load_raw reads, with equal bytes on every run, and a manifest with their SHA-256.

    With accounts, those at either end of a sampled transaction; with the lines of a pattern file, all of them, and every transaction that they name must be in the sample.
    """
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    rows = sample.orderBy("timestamp", "h").select(*TRANSACTION_COLUMNS).collect()
    lines = [",".join(r) for r in rows]
    sha = {f"{name}_Trans.csv.gz": _write_gz(out / f"{name}_Trans.csv.gz", header, lines)}
    manifest = {"transactions": len(rows), "laundering_transactions": sum(r.is_laundering == "1" for r in rows)}
    if accounts is not None:
        ends = [account_key(bank_number(F.col(f"{s}_bank")), F.col(f"{s}_account")) for s in ("from", "to")]
        used = sample.select(F.explode(F.array(*ends)).alias("__key")).distinct()
        kept = accounts.withColumn("__key", account_key(bank_number(F.col("bank_id")), F.col("account_number"))).join(used, "__key", "left_semi")
        kept = kept.orderBy("bank_id", "account_number").select(*ACCOUNT_COLUMNS).collect()
        if any("," in v or '"' in v for r in kept for v in r if v):
            raise ValueError("an account's value would need quotes")
        sha[f"{name}_accounts.csv.gz"] = _write_gz(out / f"{name}_accounts.csv.gz", account_header, [",".join(v or "" for v in r) for r in kept])
        manifest["accounts"] = len(kept)
    if pattern_lines is not None:
        held = set(lines)
        if missing := [x for x in pattern_lines if x[:4].isdigit() and x not in held]:
            raise ValueError(f"{len(missing)} pattern lines are not in the sample")
        sha[f"{name}_Patterns.txt.gz"] = _write_gz(out / f"{name}_Patterns.txt.gz", "", pattern_lines)
        manifest["pattern_rows_all_present"] = True
    manifest["sha256"] = sha
    (out / "MANIFEST.json").write_text(json.dumps(manifest, indent=2) + "\n")
    return manifest


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table of a small result; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def rewrite_block(text: str, name: str, body: str) -> str:
    """The text with what stands between the `name` markers replaced."""
    head, tail = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    before, _, rest = text.partition(head)
    _, found, after = rest.partition(tail)
    if not found:
        raise ValueError(f"no markers of {name}")
    return f"{before}{head}\n{body}\n{tail}{after}"
