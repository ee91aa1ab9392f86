"""ATT&CK tags: tactics and techniques of rules."""

from __future__ import annotations

#: Tactic names by tag.
TACTICS = {"credential_access": "Credential Access", "defense_evasion": "Defense Evasion", "execution": "Execution", "persistence": "Persistence", "privilege_escalation": "Privilege Escalation", "command_and_control": "Command and Control"}
#: Technique names by tag.
TECHNIQUES = {"t1059": "Command and Scripting Interpreter", "t1059.001": "PowerShell", "t1059.004": "Unix Shell", "t1105": "Ingress Tool Transfer", "t1110": "Brute Force", "t1218": "System Binary Proxy Execution", "t1218.005": "Mshta", "t1218.010": "Regsvr32"}
#: Tactic ids by technique id.
TECHNIQUE_TACTICS = {"T1059": ["TA0002"], "T1059.001": ["TA0002"], "T1059.004": ["TA0002"], "T1105": ["TA0011"], "T1110": ["TA0006"], "T1218": ["TA0005"], "T1218.005": ["TA0005"], "T1218.010": ["TA0005"]}
SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def tags(values: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(tactics, techniques, technique ids) of ``attack.*`` tags, in order; unknown tactics are ignored, unknown technique names are their ids."""
    tactics, techniques, ids = [], [], []
    for v in values:
        space, _, name = v.lower().partition(".")
        if space != "attack":
            continue
        if name in TACTICS:
            tactics.append(TACTICS[name])
        elif name[:1] == "t" and name[1:5].isdigit():
            ids.append(name.upper())
            techniques.append(TECHNIQUES.get(name, name.upper()))
    return tactics, techniques, ids
