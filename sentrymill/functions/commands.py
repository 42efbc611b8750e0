"""Commands as column expressions: techniques, templates, and the addresses they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .net import join_host_port

# Techniques of the ATT&CK matrix with the event kinds, substrings and patterns (of the
# lower-case command) that point to them. Word edges are ASCII ones.
_L, _R = "(?<![0-9a-z_])", "(?![0-9a-z_])"
TECHNIQUES = (
    ("T1078", "Valid Accounts", "initial-access", ("accepted",), (), ""),
    ("T1133", "External Remote Services", "initial-access", ("connect",), (), ""),
    ("T1059.004", "Unix Shell", "execution", ("command",), (), ""),
    ("T1053.003", "Cron", "persistence", (), ("crontab", "/etc/cron", "/var/spool/cron"), ""),
    ("T1098.004", "SSH Authorized Keys", "persistence", (), ("authorized_keys", ".ssh/authorized"), ""),
    ("T1070.003", "Clear Command History", "defense-evasion", (), ("history -c", ".bash_history", "unset histfile"), ""),
    ("T1562", "Impair Defenses", "defense-evasion", (), ("iptables -f", "ufw disable", "systemctl stop fail2ban", "chattr -i", "chattr +i"), ""),
    ("T1110.001", "Password Brute Force", "credential-access", ("failed_password", "invalid_user"), (), ""),
    ("T1110.002", "Public-key Brute Force", "credential-access", ("failed_publickey",), (), ""),
    ("T1033", "System Owner / User", "discovery", (), (), f"{_L}(whoami|id|who|w){_R}"),
    ("T1046", "Network Service Discovery", "discovery", (), ("netstat", "nmap", " ss -", "ss -t", "ss -l"), ""),
    ("T1082", "System Information Discovery", "discovery", (), ("uname", "/proc/cpuinfo", "/proc/meminfo", "lscpu", "lsb_release", "cat /etc/os-release", "cat /etc/issue"), ""),
    ("T1083", "File and Directory Discovery", "discovery", (), (), f"(^|[\\t\\n\\f\\r ;|&])(ls|find|pwd|dir){_R}"),
    ("T1087", "Account Discovery", "discovery", (), ("/etc/passwd", "/etc/shadow", "getent passwd", "compgen -u"), ""),
    ("T1071.004", "DNS", "command-and-control", (), ("nslookup ", "dig ", "host ", "getent hosts"), ""),
    ("T1105", "Ingress Tool Transfer", "command-and-control", ("file_download", "file_upload"), (), f"{_L}(wget|curl|tftp|ftpget|scp|rsync){_R}"),
    ("T1571", "Non-Standard Port", "command-and-control", (), (), "/dev/tcp/[^/\\t\\n\\f\\r ]+/([0-9]+)"),
    ("T1496", "Resource Hijacking", "impact", (), ("xmrig", "cgminer", "minerd", "kdevtmpfsi", "monero", "stratum+tcp"), ""),
    ("T1486", "Data Encrypted for Impact", "impact", (), ("openssl enc -aes", ".locked", "ransom"), ""),
)
# Tactics in the matrix's order; two have no technique here.
TACTICS = ("initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access", "discovery", "lateral-movement", "command-and-control", "impact")
# What becomes a placeholder, in this order.
TEMPLATE = (
    (r"https?://[^\t\n\f\r ]+", "<URL>"),
    (r"(?<![0-9A-Za-z_])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z_])", "<IP>"),
    (r"/(?:home|root|var|opt|etc|usr|tmp)/[^\t\n\f\r ;|&]+", "<PATH>"),
    (r"/tmp/[^\t\n\f\r ;|&]+", "<PATH>"),
    (r"(?<![0-9A-Za-z_])[0-9a-fA-F]{12,}(?![0-9A-Za-z_])", "<HEX>"),
    (r":[0-9]{2,5}(?![0-9A-Za-z_])", ":<PORT>"),
    (r"(?<![0-9A-Za-z_])[0-9]{3,}(?![0-9A-Za-z_])", "<N>"),
    (r"[\t\n\f\r ]+", " "),
)


def techniques(kind: Column, command: Column) -> Column:
    """Ids of the techniques that an event shows, in catalogue order."""
    c = F.lower(command)
    out = []
    for tid, _, _, kinds, parts, pattern in TECHNIQUES:
        cond = kind.isin(*kinds) if kinds else F.lit(False)
        for p in parts:
            cond = cond | c.contains(p)
        if pattern:
            cond = cond | c.rlike(pattern)
        out.append(F.when(F.coalesce(cond, F.lit(False)), F.lit(tid)))
    return F.array_compact(F.array(*out))


def template(command: Column) -> Column:
    out = F.trim(command)
    for pattern, to in TEMPLATE:
        out = F.regexp_replace(out, pattern, to)
    return out


def urls(command: Column) -> Column:
    """Distinct addresses that a command names, also as /dev/tcp targets, in order."""
    c = F.trim(command)
    http = F.regexp_extract_all(c, F.lit(r"""(https?://[^\t\n\f\r "'<>]+)"""), F.lit(1))
    raw = r"(?i)/dev/tcp/([^/\t\n\f\r ]+)/([0-9]+)"
    hosts, ports = F.regexp_extract_all(c, F.lit(raw), F.lit(1)), F.regexp_extract_all(c, F.lit(raw), F.lit(2))
    tcp = F.zip_with(hosts, ports, lambda h, p: F.concat(F.lit("http://"), join_host_port(h, p), F.lit("/")))
    clean = F.transform(F.concat(http, tcp), lambda u: F.regexp_replace(F.regexp_replace(u, "[\"']+$", ""), "[;|&]+$", ""))
    return F.array_distinct(F.filter(clean, lambda u: u != ""))


def csv_safe(value: Column) -> Column:
    """Guards a cell against being read as a formula."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), value)).otherwise(value)
