"""Classes of events: lanes, severities, shedding, bursts, and one-line texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Event types that a timeline shows.
LOAD_BEARING = ("proc.exec", "fs.sensitive_read", "net.connect", "net.dns", "fs.settle", "gap")
#: Classes that may be shed, the first to go first; and those that never are.
SHED_TIERS = {"fork_exit": 0, "fs.meta": 1, "fs.write_open": 2, "flow_dns": 3}
#: The event types of these classes.
SHED_TYPES = {
    "fork_exit": ("proc.fork", "proc.exit"), "fs.meta": ("fs.unlink", "fs.rename", "fs.mkdir", "fs.chmod", "fs.truncate"), "fs.write_open": ("fs.write_open",), "flow_dns": ("net.flow_close", "net.dns"),
}
NEVER_SHED = ("exec", "connect", "sensitive_read", "session", "gap")
#: Where and under which names known interpreters and shells are installed.
EXE_DIRS = ("/bin", "/usr/bin", "/usr/local/bin", "/sbin", "/usr/sbin")
EXE_NAMES = ("sh", "bash", "dash", "zsh", "ksh", "fish", "env", "python", "python3", "python2", "perl", "ruby", "node", "nodejs", "awk", "gawk", "sed")
EXE_PREFIXES = ("python3.", "python2.", "node", "ruby")
#: Paths whose reading is sensitive.
SENSITIVE_PATHS = (
    "~/.ssh", "~/.aws", "~/.gnupg", "~/.kube", "~/.config/gcloud", "~/.config/google-chrome", "~/.config/chromium", "~/.mozilla/firefox",
    "~/Library/Application Support/Google/Chrome", "~/Library/Application Support/Firefox", "~/.openclaw/credentials*",
)


def is_marker(t: Column) -> Column:
    return t.startswith("marker.")


def is_alert(t: Column) -> Column:
    return t.startswith("alert.")


def is_gap(t: Column) -> Column:
    return t == "gap"


def lane(t: Column) -> Column:
    process = t.startswith("proc.") | t.isin("session.start", "session.end")
    return F.when(process, "process").when(t.startswith("fs."), "filesystem").when(t.startswith("net.") | (t == "unix.connect"), "network").otherwise("other")


def severity(t: Column, high: Column) -> Column:
    """crit, warn or null. ``high``: the event is marked as of high severity."""
    crit = t.isin("alert.sensitive_read", "alert.cgroup_escape", "alert.escape_precursor") | high
    return F.when(crit, "crit").when(is_alert(t) | (t == "fs.sensitive_read"), "warn")


def event_class(t: Column) -> Column:
    """The class that load shedding accounts an event to; alerts, markers and the like count as session."""
    return F.coalesce(burst_class(t), F.when(t == "proc.exec", "exec").when(t.isin("net.connect", "unix.connect"), "connect").when(t == "fs.sensitive_read", "sensitive_read").when(t == "gap", "gap").otherwise("session"))


def never_shed(t: Column) -> Column:
    return event_class(t).isin(*NEVER_SHED)


def _by_class(t: Column, values: dict[str, object]) -> Column:
    out = F.lit(None)
    for c, types in SHED_TYPES.items():
        out = F.when(t.isin(*types), F.lit(values[c])).otherwise(out)
    return out


def shed_tier(t: Column) -> Column:
    """0 goes first, 3 last; null for what is never shed."""
    return _by_class(t, SHED_TIERS).cast("int")


def burst_class(t: Column) -> Column:
    """Bursts are looked for in the classes that may be shed; null is exempt."""
    return _by_class(t, {c: c for c in SHED_TYPES}).cast("string")


def load_bearing(t: Column) -> Column:
    return t.isin(*LOAD_BEARING) | is_alert(t)


def describe(t: Column, path: Column, addr: Column, qname: Column) -> Column:
    """One line for a timeline."""
    text = lambda c: F.coalesce(c, F.lit("?"))
    return (
        F.when(t == "proc.exec", F.concat(F.lit("executed "), text(path))).when(t == "fs.sensitive_read", F.concat(F.lit("read sensitive "), text(path)))
        .when(t == "net.connect", F.concat(F.lit("connected to "), text(addr))).when(t == "net.dns", F.concat(F.lit("resolved "), text(qname)))
        .when(t == "fs.settle", F.concat(F.lit("changed "), text(path))).when(t == "gap", F.lit("events were lost"))
        .when(t == "alert.new_domain", F.concat(F.lit("first contact with "), text(F.coalesce(qname, addr)))).when(t == "alert.sensitive_read", F.concat(F.lit("alert: sensitive read of "), text(path)))
        .when(is_alert(t), F.concat(F.lit("alert: "), F.substring(t, 7, 64))).otherwise(t)
    )


def exe_class(path: Column, dirs: tuple[str, ...] = EXE_DIRS, names: tuple[str, ...] = EXE_NAMES, prefixes: tuple[str, ...] = EXE_PREFIXES) -> Column:
    """allowlisted if both the directory and the name (or its prefix) are known, else unclassified."""
    folder, name = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    known = name.isin(*names)
    for p in prefixes:
        known = known | name.startswith(p)
    return F.when(folder.isin(*dirs) & known, "allowlisted").otherwise("unclassified")


#: File operation codes of raw records.
FS_OPS = {1: "fs.write_open", 2: "fs.unlink", 3: "fs.rename", 4: "fs.mkdir", 5: "fs.chmod", 6: "fs.truncate", 7: "fs.sensitive_read"}


def fs_op_type(op: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in FS_OPS.items():
        out = F.when(op == code, name).otherwise(out)
    return out


def proto_label(proto: Column) -> Column:
    return F.when(proto == 17, "udp").otherwise("tcp")


def family_label(family: Column) -> Column:
    return F.when(family == 6, "6").otherwise("4")


def headline(t: Column, subject: Column) -> Column:
    """An alert in a few words."""
    what = F.when(t == "alert.new_domain", "first contact").when(t == "alert.sensitive_read", "sensitive read").otherwise(F.substring(t, 7, 64))
    return F.concat(what, F.lit(": "), F.coalesce(subject, F.lit("unknown")))


#: Event families that a profile may switch off, by its column; all others are always captured.
SWITCHES = {
    "capture_fork_exit": ("proc.fork", "proc.exit"), "capture_file_write": ("fs.write_open", "fs.settle"),
    "capture_file_meta": ("fs.unlink", "fs.rename", "fs.mkdir", "fs.chmod", "fs.truncate"), "capture_flow": ("net.flow_close", "net.dns"), "capture_unix": ("unix.connect",),
}


def captured(t: Column) -> Column:
    """Whether an event's profile, whose switches stand beside it, captures its type; null switches are on."""
    on = F.lit(True)
    for switch, types in SWITCHES.items():
        on = F.when(t.isin(*types), F.coalesce(F.col(switch), F.lit(True))).otherwise(on)
    return on
