"""Best-effort extraction of user, address, port, bytes, login outcome and action from a message.

Patterns are ASCII on purpose: white space is spelled out and word borders are look-arounds over
[0-9A-Za-z_], because ``\\b`` and ``\\s`` differ between engines on other alphabets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.net import is_address, is_ip
from emberwatch.functions.text import digits

_SP = r"[\t\n\f\r ]"
_LB, _RB = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

# Fixed patterns and phrase lists (part of the contract). Case folding is Unicode's for these words:
# besides ASCII only the long s folds into it, so it is named where an s may stand. The leading
# class lets the matcher skip most positions without trying the alternatives.
FROM_ADDRESS = rf"(?i)(?=[frscſ])(?:from|rho[sſ]t=|[sſ]rc=|client=){_SP}*[:\[]?([0-9a-fA-F.:]+)"
DOTTED_QUAD = rf"{_LB}([0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}){_RB}"
USER = rf'(?i)(?=[fua])(?:for(?: invalid u[sſ]er)?|u[sſ]er=?|account(?: name)?:?){_SP}+"?([A-Za-z0-9._\-\\$]+)"?'
NAME_VALUE = rf"(?i){_LB}name=[\"']?([A-Za-z0-9._\-\\$]+)"
DST_PORT = r"(?i)(?:DPT=|dport[ =])([0-9]{1,5})"
BYTES_OUT = rf"(?i)(?=[bsſ])(?:byte[sſ][=:]?|[sſ]ent[=:]?){_SP}*([0-9]{{2,}})"
# Words without which the pattern cannot match; looked up first, as that is far cheaper.
FROM_WORDS, USER_WORDS, BYTES_WORDS = ("from", "rhost=", "src=", "client="), ("for", "user", "account"), ("bytes", "sent")
WINDOWS_HINTS = ("event", "microsoft-windows", "security")
FAILURE_PHRASES = (
    "failed password", "authentication failure", "invalid user", "failed publickey", "permission denied",
)
SUCCESS_PHRASES = ("accepted password", "accepted publickey", "session opened for user")
NEW_ACCOUNT_IDS = ("4720", "4728", "4732")
PRIVILEGED_WORDS = ("sudo", "wheel", "admin")


def _any(c: Column, words) -> Column:
    found = c.contains(words[0])
    for word in words[1:]:
        found = found | c.contains(word)
    return found


def folded(msg: Column) -> Column:
    """Lower case with the long s folded, for looking up the words above."""
    return F.translate(F.lower(msg), "ſ", "s")


def _capture(msg: Column, low: Column, words, pattern: str) -> Column:
    return F.when(_any(low, words), F.regexp_extract(msg, pattern, 1)).otherwise(F.lit(""))


def named_address(msg: Column, low: Column) -> Column:
    """Text after from / rhost= / src= / client=."""
    return _capture(msg, low, FROM_WORDS, FROM_ADDRESS)


def src_ip(msg: Column, named: Column) -> Column:
    """The named address if it is valid, else the first dotted quad, else ''."""
    return F.when(is_address(named), named).when(msg.contains("."), F.regexp_extract(msg, DOTTED_QUAD, 1)).otherwise("")


def user(msg: Column, low: Column, named: Column) -> Column:
    """The named account unless it is an address, else the value of name=."""
    return F.when((named != "") & ~is_ip(named), named).otherwise(_capture(msg, low, ("name=",), NAME_VALUE))


def dst_port(msg: Column, low: Column) -> Column:
    port = digits(_capture(msg, low, ("dpt=", "dport"), DST_PORT))
    return F.when(port.between(1, 65535), port).otherwise(F.lit(0))


def bytes_out(msg: Column, low: Column) -> Column:
    return F.coalesce(digits(_capture(msg, low, BYTES_WORDS, BYTES_OUT), "bigint"), F.lit(0).cast("bigint"))


def has_event_id(msg: Column, low: Column, *ids: str) -> Column:
    """A Windows event id as a whole number, in a line that speaks of events at all."""
    lead = rf"(?:event{_SP}*id[:=]?{_SP}*|{_LB})"
    return _any(msg, ids) & _any(low, WINDOWS_HINTS) & msg.rlike(rf"(?i){lead}(?:{'|'.join(ids)}){_RB}")


def auth_outcome(msg: Column, low: Column) -> Column:
    return (
        F.when(has_event_id(msg, low, "4625"), F.lit("failure"))
        .when(has_event_id(msg, low, "4624"), F.lit("success"))
        .when(_any(low, FAILURE_PHRASES), F.lit("failure"))
        .when(_any(low, SUCCESS_PHRASES), F.lit("success"))
        .otherwise(F.lit(""))
    )


def action(msg: Column, low: Column, app: Column) -> Column:
    added = ((F.lower(app) == "useradd") | low.contains("useradd")) & _any(low, ("new user", "new account"))
    raised = _any(low, ("usermod", "gpasswd")) & _any(low, PRIVILEGED_WORDS)
    grouped = _any(low, ("to group 'sudo'", "to group 'wheel'"))
    windows = has_event_id(msg, low, *NEW_ACCOUNT_IDS) & ~has_event_id(msg, low, "4625", "4624")
    return (
        F.when(windows | added | raised | grouped, F.lit("new_admin"))
        .when(_any(low, (" deny", "blocked", "drop")), F.lit("deny"))
        .when(_any(low, (" accept", "allow", "pass ")), F.lit("accept"))
        .otherwise(F.lit(""))
    )


def extract_fields(df: DataFrame) -> DataFrame:
    """Add auth, user, src_ip, dst_port, bytes_out and action from message (or raw) and app."""
    msg, low, fold = F.col("_msg"), F.col("_low"), F.col("_fold")
    return (
        df.withColumn("_msg", F.when(F.col("message") == "", F.col("raw")).otherwise(F.col("message")))
        .withColumns({"_low": F.lower("_msg"), "_fold": folded(msg)})
        .withColumns({"_named": named_address(msg, fold), "_account": _capture(msg, fold, USER_WORDS, USER)})
        .withColumns({
            "auth": auth_outcome(msg, low),
            "user": user(msg, fold, F.col("_account")),
            "src_ip": src_ip(msg, F.col("_named")),
            "dst_port": dst_port(msg, fold),
            "bytes_out": bytes_out(msg, fold),
            "action": action(msg, low, F.col("app")),
        })
        .drop("_msg", "_low", "_fold", "_named", "_account")
    )


def actor(src: Column = None, usr: Column = None, host: Column = None) -> Column:
    """Best identity: address, else ``user:<name>``, else host."""
    src, usr, host = (F.col(n) if c is None else c for n, c in (("src_ip", src), ("user", usr), ("host", host)))
    return F.when(src != "", src).when(usr != "", F.concat(F.lit("user:"), usr)).otherwise(host)


# Forwarded-finding tokens.
_TOKENS = {
    "product": "[a-z0-9_.-]+",
    "severity": "[a-z]+",
    "check": "[a-zA-Z0-9_.-]+",
    "status": "[a-z]+",
}


def token(msg: Column, name: str) -> Column:
    return F.regexp_extract(msg, rf"{_LB}{name}=({_TOKENS[name]})", 1)
