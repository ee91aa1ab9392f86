"""Raw telemetry to normalized events: one projection per source, unparseable records to a reject table.

Input rows: ``path`` (/sysmon, /linux, /security or a syslog tag), ``body`` (the JSON text as received), ``peer``, ``validation_id``, ``received_at``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, first_of, key_values, text, whole
from ..schema import event_columns

MAX_BYTES = 1 << 20
#: Event id, type, category.
SYSMON = {1: ("process_create", "process"), 3: ("network_connect", "network"), 7: ("image_load", "library"), 11: ("file_create", "file"), 13: ("registry_value_set", "registry"), 22: ("dns_query", "dns"), 4104: ("powershell_script", "script")}
#: Audit record type, category, action.
AUDIT = {"SYSCALL": ("process", "process_execute"), "EXECVE": ("process", "process_execute"), "USER_LOGIN": ("authentication", "user_login"), "USER_AUTH": ("authentication", "user_authentication"), "USER_ACCT": ("authentication", "account_validation"), "CRED_ACQ": ("authentication", "credential_acquire"), "CRED_DISP": ("authentication", "credential_dispose")}
#: EVE event type, category, action.
EVE = {"alert": ("intrusion_detection", "network_alert"), "dns": ("dns", "dns_query"), "http": ("web", "http_request"), "tls": ("network", "tls_session"), "flow": ("network", "network_flow")}
#: Syslog severities by the severity they fold to.
SYSLOG = {"error": ("emerg", "emergency", "alert", "crit", "critical", "err", "error"), "warning": ("warning", "warn"), "debug": ("debug",)}
SYSLOG_LEVELS = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
SYSLOG_FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron", *(f"local{i}" for i in range(8)))


def get(*paths: str) -> Column:
    """The first of the paths that the record has, as text."""
    return first_of(*[F.try_variant_get(F.col("v"), f"$.{p}", "string") for p in paths])


def choose(cases: list[tuple[Column, object]], other) -> Column:
    out = other if isinstance(other, Column) else F.lit(other)
    for test, value in reversed(cases):
        out = F.when(F.coalesce(test, F.lit(False)), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def lookup(key: Column, table: dict, at: int, other) -> Column:
    return choose([(key == k, v[at]) for k, v in table.items()], other)


def instant(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ")))


def route(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows by path; those that no route takes under ``unmatched``."""
    known = ("/sysmon", "/linux", "/security", "/syslog")
    return {k[1:]: rows.where(F.col("path") == k) for k in known} | {"unmatched": rows.where(~F.coalesce(F.col("path").isin(*known), F.lit(False)))}


def _sysmon(rows: DataFrame) -> DataFrame:
    data = lambda name, *more: get(*[f"{p}.{name}" for p in ("Event.EventData", "event.EventData", "winlog.event_data", "event_data")], *more)
    system = lambda name, flat: get(f"Event.System.{name}", f"event.System.{name}", f"winlog.{flat}", flat)
    number = whole(get("Event.System.EventID", "event.System.EventID", "winlog.event_id", "event_id", "event.code"))
    kind, category = lookup(number, SYSMON, 0, "sysmon_other"), lookup(number, SYSMON, 1, "other")
    times = first_of(F.try_variant_get(F.col("v"), "$['@timestamp']", "string"), get("timestamp", "Event.EventData.UtcTime", "event.EventData.UtcTime", "winlog.event_data.UtcTime", "event_data.UtcTime", "Event.System.TimeCreated.SystemTime", "event.System.TimeCreated.SystemTime"))
    host = first_of(get("Event.System.Computer", "event.System.Computer", "host.name", "host", "computer"), F.lit("unknown"))
    user, image, parent = data("User", "user.name", "user_name", "user"), data("Image", "process.executable", "image"), data("ParentImage", "process.parent.executable", "parent_image")
    started, record = data("Initiated", "initiated"), whole(system("EventRecordID", "record_id"))
    domain = data("QueryName", "dns.question.name", "query_name")
    out = {
        "event_time": F.coalesce(instant(times), F.col("received_at")), "ingested_at": F.col("received_at"), "event_id": number, "event_type": kind, "channel": first_of(system("Channel", "channel"), F.lit("Microsoft-Windows-Sysmon/Operational")),
        "provider_name": get("Event.System.Provider.Name", "event.System.Provider.Name", "winlog.provider_name", "provider_name"), "record_id": record, "computer": host, "user": user,
        "process_guid": data("ProcessGuid", "process_guid"), "process_id": whole(data("ProcessId", "process.pid", "process_id")), "image": image, "image_loaded": data("ImageLoaded", "image_loaded"),
        "command_line": data("CommandLine", "process.command_line", "command_line"), "parent_image": parent, "parent_command_line": data("ParentCommandLine", "process.parent.command_line", "parent_command_line"),
        "powershell_script": data("ScriptBlockText", "powershell.script", "powershell_script"), "source_ip": data("SourceIp", "source.ip", "source_ip"), "source_port": data("SourcePort", "source.port", "source_port"),
        "destination_ip": data("DestinationIp", "destination.ip", "destination_ip"), "destination_port": data("DestinationPort", "destination.port", "destination_port"), "destination_hostname": data("DestinationHostname", "destination.domain", "destination_hostname"),
        "query_name": domain, "query_status": data("QueryStatus", "query_status"), "query_results": data("QueryResults", "query_results"), "target_filename": data("TargetFilename", "file.path", "target_filename"),
        "target_object": data("TargetObject", "registry.path", "target_object"), "registry_details": data("Details", "registry_details"), "protocol": F.lower(data("Protocol", "network.transport", "protocol")),
        "initiated": F.when(F.lower(started).isin("true", "1", "yes"), 1).otherwise(0), "hashes": data("Hashes", "hashes"), "rule_name": data("RuleName", "rule_name"), "message": get("message", "Message"), "host_name": host,
        "platform": F.lit("windows"), "source_type": F.lit("windows_sysmon"), "event_category": category, "event_action": kind, "event_code": number.cast("string"), "source_event_id": record.cast("string"), "user_name": user,
        "user_id": get("Event.System.Security.UserID", "event.System.Security.UserID", "winlog.user.id", "user_id"), "process_name": basename(image), "process_path": image, "parent_process_name": basename(parent),
        "parent_process_id": whole(data("ParentProcessId", "process.parent.pid", "parent_process_id")), "outcome": F.lit("unknown"), "severity": F.lit("info"), "device_name": host, "vendor": F.lit("Microsoft"), "product": F.lit("Sysmon"),
        "event_kind": F.lit("event"), "ingestion_protocol": F.lit("http"), "ingestion_path": F.lit("/sysmon"), "original_format": F.lit("json"), "domain": domain,
    }
    return rows.select(*event_columns(out | _envelope()))


def _envelope() -> dict[str, Column]:
    return {"raw_json": F.col("body"), "source_address": F.col("peer"), "validation_id": first_of(F.col("validation_id"), get("validation_id"))}


def _linux_common() -> dict[str, Column]:
    host = first_of(get("host_name", "host.name", "host", "_HOSTNAME"), F.lit("unknown"))
    return {
        "ingested_at": F.col("received_at"), "computer": host, "host_name": host, "device_name": host, "platform": F.lit("linux"), "message": get("message", "MESSAGE"), "vendor": F.lit("Linux"), "event_kind": F.lit("event"),
        "ingestion_protocol": F.lit("http"), "ingestion_path": F.lit("/linux"), "original_format": F.lit("json"),
    }


def _auditd(rows: DataFrame) -> DataFrame:
    """A multi-line audit event: ``key=value`` pairs of its first record, arguments of its EXECVE record."""
    rows = rows.withColumn("m", text(get("message", "MESSAGE")))
    m = F.col("m")
    rows = rows.withColumn("record", F.upper(F.regexp_extract(m, r"(?m)^type=([A-Z0-9_]+)", 1)))
    body = lambda kind: F.regexp_extract(m, rf"(?m)^type={kind} ([^\r\n]+)", 1)
    # a message in a record's own quotes holds further pairs
    rows = rows.withColumn("kv", key_values(F.regexp_replace(body("[A-Z0-9_]+"), r"msg='", " "))).withColumn("args", key_values(body("EXECVE")))
    f = lambda *names: first_of(*[F.try_element_at("kv", F.lit(n)) for n in names])
    arg = lambda i: first_of(F.try_element_at("args", F.lit(f"a{i}")), f(f"a{i}"))
    blank = lambda c, *bad: F.when(~F.coalesce(c, F.lit("")).isin("", *bad), c)
    record, epoch = F.col("record"), F.regexp_extract(m, r"msg=audit\(([0-9]+(?:\.[0-9]+)?):[0-9]+\)", 1)
    serial = F.regexp_extract(m, r"msg=audit\([0-9.]+:([0-9]+)\)", 1)
    argv = F.array_join(F.filter(F.array(*[text(arg(i)) for i in range(8)]), lambda a: a != ""), " ")
    path = text(first_of(blank(f("exe")), arg(0)))
    line = first_of(blank(f("cmd")), blank(argv), path)
    both, low = F.lower(F.concat_ws(" ", path, line)), F.lower(m)
    done = F.lower(text(f("success", "res")))
    outcome = choose([(done.isin("yes", "success") | low.contains("res=success") | low.contains("success=yes"), "success"), (done.isin("no", "failed", "failure") | low.contains("res=failed") | low.contains("success=no"), "failure")], "unknown")
    command = record == "USER_CMD"
    out = _linux_common() | {
        "event_time": F.coalesce(epoch.try_cast("decimal(20,6)").cast("timestamp"), instant(get("timestamp")), F.col("received_at")), "channel": F.lit("auditd"), "provider_name": F.lit("auditd"), "source_type": F.lit("linux_auditd"), "product": F.lit("auditd"),
        "record_id": serial, "source_event_id": serial, "event_code": record, "command_line": line, "process_path": path, "image": path, "process_name": first_of(blank(f("comm")), basename(path)), "process_id": f("pid"),
        "parent_process_id": f("ppid"), "user_id": first_of(blank(f("auid"), "4294967295"), f("uid")), "user_name": blank(f("acct"), "?", "(unknown)"), "user": blank(f("acct"), "?", "(unknown)"), "source_ip": blank(f("addr", "src", "saddr"), "?"),
        "source_port": f("src_port", "sport"), "destination_ip": f("dst", "daddr"), "destination_port": f("dst_port", "dport"), "protocol": F.lower(f("proto")), "outcome": outcome, "severity": F.when(outcome == "failure", "warning").otherwise("info"),
        "event_category": F.when(command, "process").otherwise(lookup(record, AUDIT, 0, "audit")), "event_action": choose([(command & both.contains("sudo"), "sudo_command"), (command, "user_command")], lookup(record, AUDIT, 1, F.lower(record))),
        "event_type": choose([(command & both.contains("sudo"), "sudo_command"), (command, "user_command")], lookup(record, AUDIT, 1, F.lower(record))),
        "service_name": choose([(both.contains("sshd"), "ssh"), (both.contains("sudo"), "sudo"), (both.contains("/su"), "su")], text(f("unit"))),
    }
    return rows.select(*event_columns(out | _envelope()))


_ACCEPTED = r"(?i)Accepted\s+[^ ]+\s+for\s+([^ ]+)\s+from\s+([^ ]+)\s+port\s+([0-9]+)"
_FAILED = r"(?i)Failed\s+[^ ]+\s+for\s+(?:invalid user\s+)?([^ ]+)\s+from\s+([^ ]+)\s+port\s+([0-9]+)"


def _journald(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("m", text(get("message", "MESSAGE")))
    m, low = F.col("m"), F.lower(F.col("m"))
    name, comm, unit = first_of(get("SYSLOG_IDENTIFIER", "_COMM"), F.lit("journald")), text(get("_COMM", "SYSLOG_IDENTIFIER")), text(get("UNIT", "_SYSTEMD_UNIT"))
    ident = F.lower(name)
    kind = choose([
        (ident.isin("ssh", "sshd") | F.lower(unit).startswith("ssh"), "ssh"), ((ident == "sudo") | (comm == "sudo") | low.contains("sudo:"), "sudo"),
        ((ident == "su") | (comm == "su") | low.contains("pam_unix(su:"), "su"), ((ident == "systemd") | (comm == "systemd") | (F.lower(unit) == "init.scope"), "systemd"),
    ], "other")
    rows = rows.withColumn("kind", kind)
    k = F.col("kind")
    part = lambda p, i: F.regexp_extract(m, p, i)
    ssh = lambda i: F.when(part(_ACCEPTED, 1) != "", part(_ACCEPTED, i)).otherwise(part(_FAILED, i))
    command, verb = part(r"^[^ :]+\s*:\s.*COMMAND=(.+)$", 1), F.lower(part(r"(?i)^(Started|Stopped|Starting|Stopping|Failed to start)\s+[^ ]+\.service", 1))
    service = part(r"(?i)^(?:Started|Stopped|Starting|Stopping|Failed to start)\s+([^ ]+\.service)", 1)
    bad = low.contains("authentication failure")
    user = choose([((k == "ssh") & (ssh(1) != ""), ssh(1)), ((k == "sudo") & (command != ""), part(r"^([^ :]+)\s*:\s.*COMMAND=", 1))], text(get("USER")))
    outcome = choose([
        ((k == "ssh") & (part(_ACCEPTED, 1) != ""), "success"), ((k == "ssh") & ((part(_FAILED, 1) != "") | bad), "failure"), (k == "ssh", "unknown"),
        ((k == "sudo") & (bad | low.contains("not in the sudoers")), "failure"), ((k == "sudo") & ((command != "") | low.contains("session opened")), "success"), (k == "sudo", "unknown"),
        ((k == "su") & bad, "failure"), ((k == "su") & low.contains("session opened"), "success"), (k == "su", "unknown"),
        ((k == "systemd") & (verb.startswith("failed") | low.contains("failed")), "failure"), ((k == "systemd") & verb.isin("started", "stopped"), "success"), (k == "systemd", "unknown"),
        (low.contains("failure") | low.contains("failed"), "failure"),
    ], "unknown")
    action = choose([(k == "ssh", "ssh_login"), (k == "sudo", "sudo_command"), (k == "su", "su"), ((k == "systemd") & verb.startswith("start"), "service_start"), ((k == "systemd") & verb.startswith("stop"), "service_stop"), (k == "systemd", "service_activity")], "authentication_activity")
    priority = whole(get("PRIORITY"), 6)
    out = _linux_common() | {
        "event_time": F.coalesce(instant(get("timestamp")), (get("__REALTIME_TIMESTAMP").try_cast("decimal(20,0)") / 1000000).cast("timestamp"), F.col("received_at")), "channel": F.lit("journald"), "provider_name": name, "source_type": F.lit("linux_journald"), "product": F.lit("journald"),
        "event_code": first_of(get("MESSAGE_ID"), name), "source_event_id": get("__CURSOR", "_AUDIT_SESSION"), "process_name": comm, "process_path": get("_EXE"), "image": get("_EXE"), "process_id": get("_PID"), "parent_process_id": get("_PPID"),
        "user_id": get("_UID"), "user_name": user, "user": user, "command_line": F.when(k == "sudo", command), "source_ip": F.when(k == "ssh", ssh(2)), "source_port": F.when(k == "ssh", ssh(3)), "outcome": outcome, "event_action": action, "event_type": action,
        "event_category": lookup(k, {"sudo": ("process",), "systemd": ("service",)}, 0, "authentication"), "service_name": choose([(k.isin("ssh", "sudo", "su"), k), ((k == "systemd") & (service != ""), service), (k == "systemd", unit)], name),
        "severity": choose([((priority <= 3) | (outcome == "failure"), "error"), (priority == 4, "warning")], "info"),
    }
    return rows.select(*event_columns(out | _envelope()))


def _security(rows: DataFrame) -> DataFrame:
    """The envelope of security tools; EVE records of Suricata get their own categories."""
    eve = F.lower(text(first_of(get("event.event_type", "event_type"), F.lit("event"))))
    product, kind = first_of(get("product"), F.lit("generic")), first_of(get("source_type"), F.lit("generic_json"))
    suricata = (F.lower(product) == "suricata") | (kind == "suricata_eve")
    host = first_of(get("host_name", "device_name", "sensor_name", "event.host"), F.lit("unknown"))
    signature, sid = get("event.alert.signature", "event.signature"), get("event.alert.signature_id", "event.signature_id")
    domain = get("event.dns.rrname", "event.dns.query.rrname", "event.dns.queries[0].rrname", "event.dns.answers[0].rrname", "event.http.hostname", "event.tls.sni", "event.domain")
    path, web = get("event.http.url"), get("event.http.hostname")
    url = first_of(get("event.url"), F.when(path.isNotNull() & (F.coalesce(web, F.lit("")) != ""), F.concat(F.lit("http://"), web, path)), path)
    alert = suricata & (eve == "alert")
    action = F.lower(text(get("event.alert.action")))
    vendor = first_of(get("vendor"), F.lit("generic"))
    own = lambda name, other: first_of(get(name, f"event.{name}"), F.lit(other))
    event_action = choose([(suricata, lookup(eve, EVE, 1, "suricata_event"))], first_of(get("event_action", "event.event_action"), eve))
    dns = eve == "dns"
    out = {
        "event_time": F.coalesce(instant(first_of(get("event.timestamp"), F.try_variant_get(F.col("v"), "$.event['@timestamp']", "string"), get("timestamp"))), F.col("received_at")), "ingested_at": F.col("received_at"), "event_type": event_action, "channel": F.lit("security_tools"),
        "provider_name": choose([(suricata, "Suricata")], product), "computer": host, "host_name": host, "device_name": first_of(get("device_name"), host), "source_ip": get("event.src_ip", "event.source_ip", "event.source.ip"),
        "source_port": get("event.src_port", "event.source_port", "event.source.port"), "destination_ip": get("event.dest_ip", "event.destination_ip", "event.destination.ip"), "destination_port": get("event.dest_port", "event.destination_port", "event.destination.port"),
        "protocol": F.lower(get("event.proto", "event.protocol", "event.network.transport")), "destination_hostname": domain, "domain": domain, "query_name": F.when(dns, domain), "query_status": F.when(dns, get("event.dns.rcode")),
        "query_results": F.when(dns, first_of(*[F.to_json(F.try_variant_get(F.col("v"), f"$.event.dns.{p}", "variant")) for p in ("answers", "grouped")], F.lit("[]"))), "rule_name": signature, "signature": signature, "signature_id": sid,
        "rule_id": first_of(get("event.rule_id"), sid), "message": first_of(get("event.message"), signature), "url": url, "platform": choose([(suricata, "network")], first_of(get("platform"), F.lit("network"))),
        "source_type": choose([(suricata, "suricata_eve")], kind), "vendor": choose([(suricata & (vendor == "generic"), "OISF")], vendor), "product": choose([(suricata, "Suricata")], product),
        "event_kind": choose([(alert, "alert"), (suricata, "event")], own("event_kind", "event")), "event_category": choose([(suricata, lookup(eve, EVE, 0, "other"))], own("event_category", "other")), "event_action": event_action,
        "event_code": first_of(get("event.event_type", "event.event_code"), eve), "source_event_id": get("event.flow_id", "event.id"),
        "severity": choose([(alert, lookup(get("event.alert.severity"), {"1": ("high",), "2": ("medium",), "3": ("low",)}, 0, "info"))], F.lower(own("severity", "info"))),
        "outcome": choose([(alert & action.isin("blocked", "allowed"), action), (alert, "unknown")], F.lower(own("outcome", "unknown"))), "network_direction": F.lower(get("network_direction", "event.direction")),
        "ingestion_protocol": F.lit("http"), "ingestion_path": F.lit("/security"), "original_format": F.lit("json"),
    }
    return rows.select(*event_columns(out | _envelope()))


_3164 = r"^<([0-9]{1,3})>([A-Z][a-z]{2} +[0-9]{1,2} [0-9:]{8}) ([^ ]+) ([^ :\[]+)(?:\[([0-9]+)\])?: ?(.*)$"
_5424 = r"^<([0-9]{1,3})>1 ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) (?:-|((?:\[(?:[^\]\\]|\\.)*\])+)) ?(.*)$"


def _syslog(rows: DataFrame, year: int) -> DataFrame:
    """Raw RFC 3164 or RFC 5424 lines in ``body``; a line that is neither is kept whole as the message. year completes RFC 3164 times."""
    b = F.col("body")
    new = b.rlike(_5424)
    rows = rows.withColumn("new", new).withColumn("old", ~new & b.rlike(_3164))
    pick = lambda a, o: F.when(F.col("new"), F.when(F.regexp_extract(b, _5424, a) != "-", F.regexp_extract(b, _5424, a))).when(F.col("old"), F.regexp_extract(b, _3164, o) if o else F.lit(None).cast("string"))
    pri = F.when(F.col("new"), F.regexp_extract(b, _5424, 1)).when(F.col("old"), F.regexp_extract(b, _3164, 1)).cast("int")
    names = lambda xs, i: F.try_element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    level = F.coalesce(names(SYSLOG_LEVELS, pri % 8), F.lit("info"))
    severity = choose([(level.isin(*v), k) for k, v in SYSLOG.items()], "info")
    app, host, message_id = pick(4, 4), F.coalesce(pick(3, 3), F.lit("unknown")), pick(6, 0)
    old_time = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(F.regexp_extract(b, _3164, 2), " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    protocol = F.coalesce(F.col("peer_protocol") if "peer_protocol" in rows.columns else F.lit(None).cast("string"), F.lit("syslog_udp"))
    out = {
        "event_time": F.coalesce(F.when(F.col("new"), instant(pick(2, 0))), F.when(F.col("old"), old_time), F.col("received_at")), "ingested_at": F.col("received_at"), "event_type": F.lit("syslog_message"), "channel": F.lit("syslog"), "provider_name": app,
        "computer": host, "host_name": host, "device_name": host, "process_id": pick(5, 5), "process_name": app, "service_name": app, "message": F.coalesce(F.when(F.col("new"), F.regexp_extract(b, _5424, 8)).when(F.col("old"), F.regexp_extract(b, _3164, 6)), b),
        "platform": F.lit("network"), "source_type": F.lit("generic_syslog"), "event_category": F.lit("log"), "event_action": F.lit("syslog_message"), "event_code": message_id, "source_event_id": message_id, "outcome": F.lit("unknown"), "severity": severity,
        "vendor": F.lit("generic"), "product": F.coalesce(app, F.lit("syslog")), "event_kind": F.lit("event"), "ingestion_protocol": protocol, "ingestion_path": F.when(protocol == "syslog_tcp", "tcp/5514").otherwise("udp/5514"),
        "original_format": F.when(F.col("new"), "rfc5424").otherwise("rfc3164"), "syslog_facility": names(SYSLOG_FACILITIES, F.floor(pri / 8)), "syslog_application": app, "raw_json": b, "source_address": F.col("peer"), "validation_id": F.lit(""),
    }
    return rows.select(*event_columns(out))


def normalize(rows: DataFrame, year: int = 1970) -> tuple[DataFrame, DataFrame]:
    """(events, rejects). Rejects keep the input columns and say why: unknown path, no JSON object, a security envelope without an event, or more than 1 MiB."""
    rows = rows.withColumn("v", F.when(F.col("path") != "/syslog", F.try_parse_json("body")))
    kind = lambda p: F.schema_of_variant(F.try_variant_get(F.col("v"), p, "variant"))
    error = choose([
        (~F.coalesce(F.col("path").isin("/sysmon", "/linux", "/security", "/syslog"), F.lit(False)), "unknown path"), (F.octet_length("body") > MAX_BYTES, "too large"),
        ((F.col("path") != "/syslog") & ~F.coalesce(kind("$").startswith("OBJECT"), F.lit(False)), "not a JSON object"), ((F.col("path") == "/security") & ~F.coalesce(kind("$.event").startswith("OBJECT"), F.lit(False)), "no event object"),
    ], F.lit(None).cast("string"))
    marked = rows.withColumn("ingest_error", error)
    good = marked.where(F.col("ingest_error").isNull())
    audit = (F.col("path") == "/linux") & F.coalesce(get("source_type") == "linux_auditd", F.lit(False))
    parts = [_sysmon(good.where(F.col("path") == "/sysmon")), _auditd(good.where(audit)), _journald(good.where((F.col("path") == "/linux") & ~audit)), _security(good.where(F.col("path") == "/security")), _syslog(good.where(F.col("path") == "/syslog"), year)]
    return reduce(DataFrame.unionByName, parts), marked.where(F.col("ingest_error").isNotNull()).drop("v")


def self_traffic(events: DataFrame, ports: tuple[int, ...], program: str) -> DataFrame:
    """events without the shipper's own: its program talking to the collector's ports. Fields that are missing never exclude a row."""
    own = (F.lower("process_path").endswith(program.lower())) & F.col("destination_port").isin(*ports)
    return events.where(~F.coalesce(own, F.lit(False)))


def envelope(eve: DataFrame, host: str, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """EVE lines in ``value`` wrapped for /security (with the columns to keep), and the lines that are no JSON objects."""
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    head = f'{{"vendor":"OISF","product":"Suricata","source_type":"suricata_eve","platform":"network","device_name":{json.dumps(host)},"event":'
    return eve.where(ok).select(*keep, F.lit("/security").alias("path"), F.concat(F.lit(head), F.col("value"), F.lit("}")).alias("body")), eve.where(~ok)
