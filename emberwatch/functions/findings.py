"""Scalar functions on findings: identity, severity order, ids, validity, evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberwatch.functions.text import EMPTY
from emberwatch.model import EVIDENCE_LIMIT_BYTES, SEVERITIES

# Fixed value: the id alphabet (base 32 without I, L, O, U) next to the usual base-32 digits.
_BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def fingerprint(module: Column, target: Column, check: Column, discriminator: Column) -> Column:
    """128-bit identity of "the same problem on the same target"."""
    return F.substring(F.sha2(F.concat_ws("|", module, target, check, discriminator), 256), 1, 32)


def severity_rank(sev: Column, unknown: int = -1) -> Column:
    """critical 4 ... info 0; unknown values rank lowest (the notifier treats them as info: 0)."""
    out = F.lit(unknown)
    for rank, name in enumerate(reversed(SEVERITIES)):
        out = F.when(sev == name, rank).otherwise(out)
    return out


def is_severity(sev: Column) -> Column:
    return sev.isin(*SEVERITIES)


def sortable_id(at: Column, seed: Column) -> Column:
    """26 characters that sort by time: 48-bit milliseconds, then 80 bits taken from a hash.

    The tail comes from the seed and not from a random source, so a retried task writes the same id.
    """
    digest = F.sha2(seed, 256)

    def base32(number: Column, base: int, width: int) -> Column:
        return F.lpad(F.conv(number, base, 32), width, "0")

    raw = F.concat(
        base32(F.floor(F.unix_micros(at) / 1000).cast("string"), 10, 10),
        base32(F.substring(digest, 1, 10), 16, 8),
        base32(F.substring(digest, 11, 10), 16, 8),
    )
    return F.translate(raw, _BASE32, _CROCKFORD)


def reject(finding: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """(field, reason) of the first thing that makes a finding unusable; both NULL if it is fine."""
    col = lambda name: (finding or {}).get(name, F.col(name))
    field, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    bad = ~is_severity(col("severity"))
    field = F.when(bad, F.lit("severity"))
    reason = F.when(bad, F.concat(F.lit("unknown value: "), col("severity")))
    for name in ("remediation", "title", "check", "target", "fingerprint"):
        why = "empty (every finding must tell the user what to do)" if name == "remediation" else "empty"
        empty = col(name) == EMPTY
        field = F.when(empty, F.lit(name)).otherwise(field)
        reason = F.when(empty, F.lit(why)).otherwise(reason)
    return field, reason


def cap_evidence(evidence: Column, limit: int = EVIDENCE_LIMIT_BYTES) -> Column:
    """Replace an oversized evidence document by a marker; cutting JSON would corrupt it."""
    size = F.octet_length(evidence)
    marker = F.concat(
        F.lit('{"_note":"evidence exceeded MaxEvidenceBytes and was dropped","_original_bytes":'),
        size.cast("string"), F.lit(',"_truncated":true}'),
    )
    return F.when(size > limit, marker).otherwise(evidence)


def compact_json(value: Column) -> Column:
    """JSON text with NULL fields left out and <, >, & escaped, as the evidence size is defined on it."""
    out = F.to_json(value)
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out
