"""Record layouts, fixed vocabularies and tunables.

Text columns use the empty string and numeric columns use 0 for "absent"; NULL is used only for
values that are genuinely optional (``resolved_at``, ``group_id``, ``verified_at``).
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed vocabularies (values must stay as they are: they appear in results).
MODULE = "emberwatch"
SOURCE_TYPES = ("syslog", "file", "journald", "docker", "windows")
SEVERITIES = ("critical", "high", "medium", "low", "info")
STATUSES = ("open", "resolved", "acknowledged", "suppressed")
# Order of the detectors on one event, in which a chain sees their detections.
KIND_ORDER = {
    "brute_force": 1,
    "scan": 2,
    "exfil": 3,
    "new_admin": 4,
    "auth_spike": 5,
    "sentinel_finding": 6,
}
SUCCESS_ORDER = 7
PARSE_RATE_CHECK = "ingest.parse_rate"
INCIDENT_CHECK = "incident.killchain"
EVIDENCE_LIMIT_BYTES = 65536
ACTIVE_WINDOW_S = 30 * 60
DETECTION_KEEP_S = 60 * 60

EVENT_SCHEMA = (
    "ts timestamp, seq bigint, source string, source_id string, host string, app string, "
    "severity int, message string, auth string, user string, src_ip string, dst_port int, "
    "bytes_out bigint, action string, raw string, parsed boolean"
)

DETECTION_SCHEMA = (
    "kind string, severity string, actor string, target string, user string, title string, "
    "detail string, count bigint, first_at timestamp, last_at timestamp, evidence array<string>, "
    "key string, source_id string, seq bigint, ord int"
)

RECORD_SCHEMA = (
    "source_id string, key string, check string, severity string, actor string, target string, "
    "title string, detail string, evidence array<string>, fix string, count bigint, "
    "first_at timestamp, last_at timestamp, seq bigint, ord int"
)

FINDING_SCHEMA = (
    "fingerprint string, target string, check string, title string, severity string, "
    "remediation string, evidence string"
)

STATE_SCHEMA = (
    "module string, target string, check string, fingerprint string, title string, "
    "severity string, remediation string, evidence string, id string, status string, "
    "group_id string, first_seen timestamp, last_seen timestamp, resolved_at timestamp, "
    "absent_streak int"
)

SOURCE_SCHEMA = (
    "name string, type string, params map<string,string>, enabled boolean, created_at timestamp"
)


def columns(schema: str) -> list[str]:
    """Top-level column names of one of the DDL strings above."""
    return [part.strip().split(" ")[0] for part in schema.replace("map<string,string>", "map").split(",")]


@dataclass(frozen=True)
class DetectConfig:
    """Detector thresholds. Durations are seconds."""

    brute_failures: int = 8
    brute_window_s: int = 60
    scan_ports: int = 10
    scan_window_s: int = 30
    exfil_bytes: int = 50 * 1024 * 1024
    exfil_factor: float = 4.0
    exfil_window_s: int = 60
    spike_min: int = 20
    spike_sources: int = 3
    spike_window_s: int = 60
    cooldown_s: int = 300
    evidence_max: int = 5

    @classmethod
    def of(cls, **overrides) -> "DetectConfig":
        """Build a config where a zero or missing value means the default."""
        return cls(**{name: value for name, value in overrides.items() if value})


@dataclass(frozen=True)
class ChainConfig:
    """Kill-chain linking window and per-actor incident cooldown, in seconds."""

    window_s: int = 600
    cooldown_s: int = 900

    @classmethod
    def of(cls, window_s: int = 0, cooldown_s: int = 0) -> "ChainConfig":
        return cls(window_s if window_s > 0 else 600, cooldown_s if cooldown_s > 0 else 900)
