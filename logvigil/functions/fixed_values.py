"""Word lists, lookup tables, patterns and texts that decide results.

Nothing here is logic. Each constant is part of the data contract and must not be changed
without changing the results of every job that reads it.
"""

from __future__ import annotations

# ---- fixed values: ingest ---------------------------------------------------------------

CORE_FIELDS = ["timestamp", "ip_address", "username", "event_type", "status"]

# What each format adds to the core fields in the summary of a parse.
FORMAT_FIELDS = {
    "syslog": ["hostname", "process", "pid", "message", "severity"],
    "apache_combined": ["ip", "ident", "user", "method", "path", "protocol", "status_code", "bytes", "referer", "user_agent"],
    "json": ["severity", "message", "json"],
    "generic": ["level", "key_values", "json", "message"],
}

NULL_TOKENS = ["", "-", "null", "NULL", "None"]

ALLOWED_EXTENSIONS = [".log", ".csv", ".json", ".jsonl"]
ALLOWED_MIME_TYPES = [
    "text/plain", "text/csv", "application/csv", "application/vnd.ms-excel",
    "application/octet-stream", "application/json", "application/x-ndjson",
    "application/jsonlines",
]

IPV4_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?:{IPV4_OCTET}\.){{3}}{IPV4_OCTET}"

FAILED_WORDS = ["failed", "failure", "invalid", "denied", "blocked", "error", "reject", "rejected"]
SUCCESS_WORDS = ["accepted", "success", "successful", "allowed", "pass", "passed", "ok"]
INFO_WORDS = ["closed", "disconnected", "started", "stopped", "info"]

STATUS_ALIASES = {
    "fail": "FAILED", "failed": "FAILED", "failure": "FAILED", "denied": "FAILED",
    "blocked": "FAILED", "rejected": "FAILED", "error": "FAILED",
    "success": "SUCCESS", "successful": "SUCCESS", "accepted": "SUCCESS", "allowed": "SUCCESS",
    "pass": "SUCCESS", "passed": "SUCCESS", "ok": "SUCCESS",
    "info": "INFO", "closed": "INFO", "disconnected": "INFO",
    "unknown": "UNKNOWN",
}

EVENT_TYPE_WORDS = [
    ("privilege_escalation", ["sudo"]),
    ("connection_closed", ["connection closed", "disconnected"]),
    ("login_attempt", ["password", "login", "authentication", "auth", "invalid user"]),
    ("port_scan", ["port_scan", "scan"]),
    ("dns_query", ["dns"]),
]

USERNAME_PATTERNS = [
    r"\bfor\s+(?:invalid user\s+)?([A-Za-z0-9_.-]+)\b",
    r"\bfrom\s+user\s+([A-Za-z0-9_.-]+)\b",
    r"\binvalid user\s+([A-Za-z0-9_.-]+)\b",
    r"\buser=([A-Za-z0-9_.-]+)\b",
    r"\bUSER=([A-Za-z0-9_.-]+)\b",
    r"\buser:\s*([A-Za-z0-9_.-]+)\b",
    r"\busername[:=]\s*([A-Za-z0-9_.-]+)\b",
    r"\b([A-Za-z0-9_.-]+)\s+:\s+TTY=",
    r"\blogname=([A-Za-z0-9_.-]+)\b",
]

SEVERITY_WORDS = [
    ("CRITICAL", ["critical", "crit"]),
    ("ERROR", ["error", "err"]),
    ("WARNING", ["warning", "warn", "failed", "failure", "invalid", "denied"]),
    ("INFO", ["info", "accepted", "started", "stopped"]),
    ("DEBUG", ["debug"]),
]

SYSLOG_HINT = r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+"
APACHE_HINT = r"^\S+\s+\S+\s+\S+\s+\[\d{2}/\w+/\d{4}"
SYSLOG_LINE = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:\s+(.*)$"
APACHE_LINE = (
    r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d{3})\s+(\S+)'
    r'(?:\s+"([^"]*)"\s+"([^"]*)")?'
)
TIMESTAMP_PATTERNS = [
    r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)",
    r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})",
    r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})",
]
LEVEL_PATTERN = r"(?i)\b(CRITICAL|FATAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|NOTICE)\b"
KEY_VALUE_PATTERN = r'(\w+)=(?:"([^"]*)"|([\w./:\-]+))'
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

JSON_CONTAINER_KEYS = ["events", "logs", "records", "results", "items", "data"]
JSON_ALIASES = {
    "timestamp": ["timestamp", "@timestamp", "_time", "event_time", "time", "date", "created_at"],
    "ip_address": ["ip_address", "source_ip", "src_ip", "src", "client_ip", "remote_addr", "ip",
                   "source.ip", "client.ip"],
    "username": ["username", "user", "user_name", "account", "principal", "user.name"],
    "event_type": ["event_type", "event", "action", "activity", "type", "event.action",
                   "event.category"],
    "status": ["status", "result", "outcome", "verdict", "event.outcome"],
    "severity": ["severity", "level", "log.level"],
    "message": ["message", "raw_message", "description", "_raw"],
}
CSV_ALIASES = {
    "timestamp": ["timestamp", "time", "date"],
    "ip_address": ["ip_address", "source_ip", "src_ip", "ip", "client_ip"],
    "username": ["username", "user", "account"],
    "event_type": ["event_type", "event", "action", "activity"],
    "status": ["status", "result", "outcome"],
}
GENERIC_ALIASES = {
    "ip_address": ["ip_address", "source_ip", "src_ip", "src", "ip"],
    "username": ["username", "user", "account"],
    "event_type": ["event_type", "event", "action"],
    "status": ["status", "result", "outcome"],
}

AUTH_FIELDS = ["timestamp", "host", "source", "ip", "user", "event_type", "status"]
AUTH_SYSLOG_LINE = (
    r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([A-Za-z0-9_\-/]+)(?:\[\d+\])?:\s*(.*)$"
)
AUTH_LEGACY_LINE = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(.*)$"
AUTH_IP = r"(\d{1,3}(?:\.\d{1,3}){3})"
AUTH_USER_PATTERNS = {
    "failed_login": [r"Failed password for invalid user\s+(\S+)", r"Failed password for\s+(\S+)"],
    "invalid_user": [r"Invalid user\s+(\S+)"],
    "successful_login": [r"Accepted password for\s+(\S+)"],
    "sudo_auth_failure": [r"user=(\S+)", r"for user\s+(\S+)",
                          r"authentication failure.*?ruser=(\S+)"],
}

# ---- fixed values: stored vocabulary ----------------------------------------------------

SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_STATUSES = ["NEW", "REVIEWING", "ESCALATED", "CLOSED"]
INCIDENT_STATUSES = ["OPEN", "INVESTIGATING", "RESOLVED", "FALSE_POSITIVE"]
MAX_NOTES_PER_INCIDENT = 5

# ---- fixed values: dashboard vocabulary -------------------------------------------------

RISK_SCORES = {"critical": 96, "high": 82, "medium": 58, "low": 30, "info": 10}
SEVERITY_RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
ALERT_STATUS_VIEW = {
    "NEW": "new", "REVIEWING": "investigating", "ESCALATED": "escalated", "CLOSED": "resolved",
}
ALERT_STATUS_STORED = {
    "new": "NEW", "investigating": "REVIEWING", "escalated": "ESCALATED", "resolved": "CLOSED",
}
INCIDENT_STATUS_VIEW = {
    "OPEN": "open", "INVESTIGATING": "investigating", "RESOLVED": "resolved",
    "FALSE_POSITIVE": "false positive", "CLOSED": "resolved",
}
INCIDENT_STATUS_STORED = {
    "open": "OPEN", "investigating": "INVESTIGATING", "resolved": "RESOLVED",
    "false positive": "FALSE_POSITIVE",
}
TERMINAL_INCIDENT_STATUSES = ["resolved", "false positive"]
TERMINAL_ALERT_STATUSES = ["contained", "resolved", "closed", "false positive"]
TIME_RANGES = {  # name -> (seconds, buckets)
    "1h": (3600, 12), "24h": (86400, 12), "7d": (604800, 7), "30d": (2592000, 10),
    "all": (None, 12),
}
RESPONSE_STEP_COUNT = 6  # default response checklist length
EXPORT_COLUMNS = {
    "events": ["id", "timestamp", "source", "sourceIp", "user", "event", "severity", "status",
               "risk", "rule"],
    "incidents": ["id", "title", "owner", "priority", "status", "updated", "completedAt",
                  "completedBy", "summary"],
    "alerts": ["id", "ruleId", "ruleName", "severity", "status", "sourceIp", "user", "firstSeen",
               "lastSeen", "summary"],
}

# ---- fixed values: detection rules ------------------------------------------------------

RULE_TITLES = {
    "brute_force_login": "Possible brute-force login activity",
    "invalid_user_enumeration": "Possible username enumeration",
    "sudo_failure": "Repeated sudo authentication failures",
    "password_spraying": "Possible password spraying",
    "credential_stuffing_success": "Possible account takeover after credential stuffing",
    "port_scan": "Possible port scan activity",
}
RULE_IDS = {
    "brute_force_login": "R-101",
    "invalid_user_enumeration": "R-102",
    "sudo_failure": "R-103",
    "password_spraying": "R-104",
    "credential_stuffing_success": "R-105",
    "port_scan": "R-106",
}
RULE_DESCRIPTIONS = {  # {subject}, {count} and {window} are filled per alert
    "brute_force_login":
        "Brute-force detected from {subject}: {count} failed login attempts within {window}s.",
    "invalid_user_enumeration":
        "Username enumeration detected from {subject}: {count} distinct usernames tried within {window}s.",
    "sudo_failure":
        "Repeated sudo failures for '{subject}': {count} failures within {window}s. "
        "Possible privilege escalation attempt.",
    "password_spraying":
        "Password spraying detected against '{subject}': {count} distinct source IPs failed to "
        "authenticate within {window}s.",
    "credential_stuffing_success":
        "Credential stuffing from {subject}: a successful login followed {failures} failed "
        "login attempts.",
    "port_scan": "Port scan detected from {subject}: {count} scan events within {window}s.",
}
RULE_CATALOG_COLUMNS = [
    "id", "engine_key", "name", "description", "technique", "severity", "owner", "criteria",
    "input", "group_by", "query", "response",
]
RULE_CATALOG = [
    ("R-101", "brute_force_login", "Brute-force login detection",
     "Detects concentrated failed login attempts from one source address.",
     "T1110.001 · Password Guessing", "high", "Detection Engineering",
     "5 failed login attempts from one source IP within 60 seconds",
     "FAILED login_attempt events with a source IP", "Source IP",
     "status=FAILED event_type=login_attempt | window 60s by source_ip | count >= 5",
     "Block the source IP, reset affected credentials, and review successful logins from the same source."),
    ("R-102", "invalid_user_enumeration", "Invalid account enumeration",
     "Detects one source attempting several distinct account names during failed logins.",
     "T1087 · Account Discovery", "medium", "Identity Security",
     "3 distinct usernames from one source IP within 600 seconds",
     "FAILED login_attempt events with a source IP and username", "Source IP",
     "status=FAILED event_type=login_attempt | window 600s by source_ip | distinct(username) >= 3",
     "Investigate and block the source IP, then review the attempted identities for targeted reconnaissance."),
    ("R-103", "sudo_failure", "Repeated sudo failure",
     "Detects repeated failed privilege-escalation attempts by the same user or source.",
     "T1548 · Abuse Elevation Control Mechanism", "medium", "Linux Security",
     "3 failed sudo attempts by one user or source within 300 seconds",
     "FAILED privilege_escalation events", "Username, falling back to source IP",
     "status=FAILED event_type=privilege_escalation | window 300s by user or source_ip | count >= 3",
     "Review the account and host, enforce MFA for privileged access, and audit any successful sudo activity."),
    ("R-104", "password_spraying", "Password spraying detection",
     "Detects one account receiving failed logins from many distinct source IPs, staying under per-IP brute-force thresholds.",
     "T1110.003 · Password Spraying", "high", "Detection Engineering",
     "5 distinct source IPs failing to authenticate against one username within 600 seconds",
     "FAILED login_attempt events with a source IP and username", "Username",
     "status=FAILED event_type=login_attempt | window 600s by username | distinct(source_ip) >= 5",
     "Lock or force a password reset on the targeted account, block the offending source IPs, and confirm MFA is enforced."),
    ("R-105", "credential_stuffing_success", "Credential stuffing success",
     "Detects a successful login from a source IP immediately after a burst of failed logins from that same IP — a likely account takeover.",
     "T1110 · Brute Force + T1078 · Valid Accounts", "high", "Detection Engineering",
     "5 failed login attempts from one source IP within 60 seconds, followed by a successful login from that IP within 120 seconds",
     "FAILED and SUCCESS login_attempt events with a source IP", "Source IP",
     "status=FAILED event_type=login_attempt | window 60s by source_ip | count >= 5 | followed_by status=SUCCESS within 120s",
     "Treat the account as compromised: force a password reset, revoke active sessions, and review activity performed after the successful login."),
    ("R-106", "port_scan", "Port scan detection",
     "Detects a burst of port-scan events from one source IP, indicating network service discovery.",
     "T1046 · Network Service Discovery", "medium", "Network Security",
     "10 scan events from one source IP within 60 seconds",
     "port_scan events with a source IP", "Source IP",
     "event_type=port_scan | window 60s by source_ip | count >= 10",
     "Block the source IP at the perimeter and review which services or ports it probed for follow-on exploitation attempts."),
]

# ---- fixed values: response playbooks ---------------------------------------------------

PLAYBOOK_KEYWORDS = [  # first playbook with a keyword in the alert text wins
    ("bruteForce", ["r-101", "brute_force", "brute-force"]),
    ("invalidUser", ["r-102", "invalid_user", "invalid user", "enumeration"]),
    ("sudoFailure", ["r-103", "sudo_failure", "sudo failure"]),
    ("bruteForce", ["r-104", "password_spraying", "password spray"]),
    ("credentialStuffing", ["r-105", "credential_stuffing", "credential stuffing", "account takeover"]),
    ("portScan", ["r-106", "port_scan", "port scan"]),
    ("successfulLogin", ["successful login", "login success", "accepted password"]),
    ("powershell", ["r-411", "powershell", "script execution"]),
    ("missingMfa", ["r-620", "without mfa", "mfa policy"]),
    ("threatIntel", ["r-205", "threat intelligence", "malicious ip"]),
    ("malware", ["r-430", "malware"]),
    ("domainReputation", ["r-507", "domain reputation", "newly registered domain"]),
    ("exfiltration", ["r-710", "exfiltration", "outbound transfer"]),
]
PLAYBOOKS = {
    "bruteForce": [
        "Block the source IP at the perimeter while validation is in progress.",
        "Reset the affected account password and revoke active sessions.",
        "Review successful authentications from the same source and targeted identities.",
        "Confirm MFA and privileged-login restrictions are enforced.",
    ],
    "invalidUser": [
        "Investigate the source IP and block it when the activity is not authorized.",
        "Review the attempted account names for targeted identity enumeration.",
        "Check the source for related authentication or reconnaissance alerts.",
    ],
    "sudoFailure": [
        "Review the affected account, host, and preceding login activity.",
        "Enable or enforce MFA for privileged access.",
        "Audit successful sudo activity and rotate credentials if compromise is suspected.",
    ],
    "credentialStuffing": [
        "Treat the account as compromised: force a password reset and revoke active sessions immediately.",
        "Block the source IP and review activity performed after the successful login.",
        "Confirm MFA is enforced before restoring access to the account.",
    ],
    "portScan": [
        "Block the source IP at the network perimeter while validation is in progress.",
        "Review which services or ports were probed for follow-on exploitation attempts.",
        "Correlate with other alerts from the same source for broader reconnaissance activity.",
    ],
    "successfulLogin": [
        "Lock the affected account and revoke active sessions.",
        "Investigate the source host and destination system for compromise.",
        "Reset credentials and validate MFA enrollment before restoring access.",
    ],
    "powershell": [
        "Isolate the affected host if the execution is not approved.",
        "Collect the process tree, command line, script content, and file hashes.",
        "Block confirmed malicious indicators and hunt for related execution.",
    ],
    "missingMfa": [
        "Revoke the privileged cloud session and restrict the affected account.",
        "Enforce MFA before allowing another privileged sign-in.",
        "Review cloud audit activity for changes made during the session.",
    ],
    "threatIntel": [
        "Block the matched indicator at the appropriate network control.",
        "Review related inbound and outbound traffic for successful exploitation.",
        "Validate exposure of the targeted asset and escalate confirmed compromise.",
    ],
    "malware": [
        "Isolate the endpoint and quarantine the detected artifact.",
        "Collect endpoint indicators and investigate the process ancestry.",
        "Hunt for the same indicators and reset credentials if theft is possible.",
    ],
    "domainReputation": [
        "Block the domain when it is not required for approved business activity.",
        "Identify clients that resolved or contacted the domain.",
        "Inspect those systems for payload delivery and recurring DNS activity.",
    ],
    "exfiltration": [
        "Contain the affected host or identity and block the destination.",
        "Preserve proxy, endpoint, and identity evidence for the transfer window.",
        "Determine what data left the environment and notify the response lead.",
    ],
}

# Result texts of the threat summary.
CORRELATE = "Correlate the account, source, and host activity before containment."
ATTEMPT_CORRELATE = "Possible privilege escalation attempt. Correlate the account, source, and host activity before containment."

# Longest texts of stored columns, most tags of a note and longest tag.
LOG_LENGTHS = {"source_filename": 255, "source_format": 50, "username": 100, "event_type": 100, "status": 30, "severity": 30}
ALERT_LENGTHS = {"rule": 100, "title": 150, "severity": 20, "status": 30, "username": 100}
USER_LENGTHS = {"username": 50, "email": 255, "full_name": 100}
ROLE_LENGTHS = {"name": 50}
MOST_TAGS, LONGEST_TAG = 6, 40

# Spellings of numbers that are not finite, in any case.
NOT_FINITE = ["nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]
