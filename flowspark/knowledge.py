"""Threat knowledge base: one entry per class, as a small table."""

import pyarrow as pa

from flowspark.schema import LABELS, small_table

# Category and severity per class.
CATEGORY = {
    0: ("Normal Traffic", "NONE"),
    1: ("Malware / Botnet", "HIGH"),
    2: ("Denial of Service", "CRITICAL"),
    3: ("Denial of Service", "HIGH"),
    4: ("Denial of Service", "HIGH"),
    5: ("Denial of Service", "HIGH"),
    6: ("Denial of Service", "HIGH"),
    7: ("Brute Force", "HIGH"),
    8: ("Vulnerability Exploitation", "CRITICAL"),
    9: ("Advanced Persistent Threat", "CRITICAL"),
    10: ("Reconnaissance", "MEDIUM"),
    11: ("Brute Force", "HIGH"),
    12: ("Web Attack", "HIGH"),
    13: ("Web Attack", "CRITICAL"),
    14: ("Web Attack", "HIGH"),
}

# Public technique codes per class in the knowledge base.
TECHNIQUES = {
    0: [],
    1: ["T1071", "T1095", "T1571", "T1008", "T1102"],
    2: ["T1498", "T1498.001", "T1498.002"],
    3: ["T1499", "T1499.002"],
    4: ["T1499", "T1499.002"],
    5: ["T1499", "T1499.002"],
    6: ["T1499", "T1499.001"],
    7: ["T1110", "T1110.001", "T1110.003"],
    8: ["T1212", "T1190", "T1587.003"],
    9: ["T1566", "T1021", "T1041", "T1055", "T1027", "T1003"],
    10: ["T1046", "T1595", "T1595.001"],
    11: ["T1110", "T1110.001", "T1110.004"],
    12: ["T1110", "T1110.003", "T1190"],
    13: ["T1190", "T1555", "T1005"],
    14: ["T1059.007", "T1185", "T1534"],
}

# Public names of those techniques.
TECHNIQUE_NAMES = {
    "T1003": "OS Credential Dumping",
    "T1005": "Data from Local System",
    "T1008": "Fallback Channels",
    "T1021": "Remote Services",
    "T1027": "Obfuscated Files or Information",
    "T1041": "Exfiltration Over C2 Channel",
    "T1046": "Network Service Discovery",
    "T1055": "Process Injection",
    "T1059.007": "JavaScript",
    "T1071": "Application Layer Protocol",
    "T1095": "Non-Application Layer Protocol",
    "T1102": "Web Service",
    "T1110": "Brute Force",
    "T1110.001": "Password Guessing",
    "T1110.003": "Password Spraying",
    "T1110.004": "Credential Stuffing",
    "T1185": "Browser Session Hijacking",
    "T1190": "Exploit Public-Facing Application",
    "T1212": "Exploitation for Credential Access",
    "T1498": "Network Denial of Service",
    "T1498.001": "Direct Network Flood",
    "T1498.002": "Reflection Amplification",
    "T1499": "Endpoint Denial of Service",
    "T1499.001": "OS Exhaustion Flood",
    "T1499.002": "Service Exhaustion Flood",
    "T1534": "Internal Spearphishing",
    "T1555": "Credentials from Password Stores",
    "T1566": "Phishing",
    "T1571": "Non-Standard Port",
    "T1587.003": "Digital Certificates",
    "T1595": "Active Scanning",
    "T1595.001": "Scanning IP Blocks",
}

# Tactics per class in the knowledge base.
TACTICS = {
    0: [],
    1: ["Command and Control", "Exfiltration", "Impact"],
    2: ["Impact"],
    3: ["Impact"],
    4: ["Impact"],
    5: ["Impact"],
    6: ["Impact"],
    7: ["Credential Access", "Initial Access"],
    8: ["Credential Access", "Collection", "Initial Access"],
    9: ["Initial Access", "Execution", "Lateral Movement", "Exfiltration"],
    10: ["Discovery", "Reconnaissance"],
    11: ["Credential Access", "Initial Access"],
    12: ["Credential Access", "Initial Access"],
    13: ["Initial Access", "Collection", "Credential Access"],
    14: ["Collection", "Credential Access", "Execution"],
}

# True tactics and techniques per class that the knowledge base is scored against.
TRUTH = {
    0: ([], []),
    1: (["Command and Control", "Collection"], ["T1071", "T1571", "T1041"]),
    2: (["Impact"], ["T1498", "T1499"]),
    3: (["Impact"], ["T1499", "T1499.002"]),
    4: (["Impact"], ["T1499", "T1499.002"]),
    5: (["Impact"], ["T1499", "T1499.001"]),
    6: (["Impact"], ["T1499", "T1499.001"]),
    7: (["Credential Access"], ["T1110", "T1110.001"]),
    8: (["Initial Access", "Collection"], ["T1190", "T1212"]),
    9: (["Initial Access", "Lateral Movement"], ["T1189", "T1570"]),
    10: (["Reconnaissance", "Discovery"], ["T1046", "T1018"]),
    11: (["Credential Access"], ["T1110", "T1110.001"]),
    12: (["Credential Access"], ["T1110", "T1110.001"]),
    13: (["Initial Access"], ["T1190"]),
    14: (["Initial Access", "Execution"], ["T1190", "T1059.007"]),
}

# Our own wording: description, log signs, network signs, actions, tags.
NOTES = {
    0: ("Ordinary traffic between known services with steady volumes and completed handshakes.",
        ["handshakes complete", "name lookups precede connections"],
        [], ["keep as baseline"], ["benign", "baseline"]),
    1: ("A host under remote control calls its operator at a steady beat and receives small orders.",
        ["evenly spaced connections to one peer", "lookups of random-looking names", "self-signed certificates"],
        ["small encrypted flows to rare ports", "the same payload size again and again"],
        ["quarantine the host", "sinkhole the controller name", "collect memory and persistence entries"],
        ["bot", "c2", "beacon", "malware"]),
    2: ("Many sources send more packets than the target or its uplink can take.",
        ["connection count far above baseline", "half-open connections dominate", "large unsolicited answers"],
        ["many source networks, one target", "link saturation"],
        ["divert traffic to a scrubbing service", "rate-limit at the edge", "inform the upstream provider"],
        ["ddos", "flood", "volumetric", "availability"]),
    3: ("A single tool keeps many web connections busy with cache-defeating requests.",
        ["long web connections with few bytes", "varying user agents from one source"],
        ["hundreds of parallel requests by one client"],
        ["shorten keep-alive", "cap connections per client", "block the source"],
        ["dos", "http", "goldeneye", "application-layer"]),
    4: ("One client floods a web server with unique page requests so that no cache can help.",
        ["get requests with random parameters", "one request per user agent"],
        ["request rate of one client far above the rest"],
        ["challenge clients", "throttle at the load balancer", "block the source"],
        ["dos", "http", "hulk", "request-flood"]),
    5: ("Requests are sent a few bytes at a time so that server workers stay occupied.",
        ["connections of minutes with almost no data", "request bodies that trickle in"],
        ["worker pool full while bandwidth is idle"],
        ["demand a minimum data rate", "limit header time", "limit body size"],
        ["dos", "slow-http", "worker-exhaustion"]),
    6: ("Request headers are started and never finished, one worker per connection.",
        ["many open connections with partial headers", "tiny keep-alive lines"],
        ["one source holds hundreds of open requests"],
        ["set a header timeout", "put a buffering proxy in front", "cap connections per client"],
        ["dos", "slowloris", "slow-headers"]),
    7: ("A password list is tried against a file-transfer server.",
        ["short connections to port 21 in quick succession", "rejected logins"],
        ["one source, many login attempts", "failure replies dominate"],
        ["lock out after failures", "move to an encrypted protocol", "review successful logins"],
        ["brute-force", "ftp", "password", "port-21"]),
    8: ("A malformed keep-alive message makes a vulnerable TLS server return parts of its memory.",
        ["heartbeat messages before encryption starts", "answers larger than their requests"],
        ["repeated short TLS sessions with large replies"],
        ["update the TLS library", "replace keys and certificates", "end all login sessions"],
        ["heartbleed", "tls", "memory-disclosure", "openssl"]),
    9: ("A foothold inside the network is used to move on, collect data and send it out.",
        ["internal hosts contacted for the first time", "downloads with mismatched types", "odd hours"],
        ["internal sweep followed by a large upload", "remote administration from a workstation"],
        ["start incident response", "isolate the segment", "secure evidence", "reset used accounts"],
        ["intrusion", "lateral-movement", "exfiltration", "multi-stage"]),
    10: ("One source probes many ports or hosts to learn which services answer.",
         ["attempts without reply or with reset", "ports in sequence"],
         ["high port entropy from one source", "very short flows"],
         ["block the source", "close services that need not be open", "watch for a follow-up"],
         ["portscan", "reconnaissance", "probing"]),
    11: ("A password list is tried against a remote-shell server.",
         ["short connections to port 22 with equal length", "failed logins"],
         ["one source, many shell logins per minute"],
         ["allow keys only", "ban sources after failures", "review successful logins"],
         ["brute-force", "ssh", "password", "port-22"]),
    12: ("A password list is tried against the login form of a web application.",
         ["repeated posts to a login page", "denied answers in a row"],
         ["one client, many form submissions", "equal request sizes"],
         ["slow down repeated logins", "require a second factor", "alert on locked accounts"],
         ["web-attack", "brute-force", "login-form"]),
    13: ("Database statements are smuggled in through request parameters.",
         ["query words and quotes in addresses", "server errors followed by large answers"],
         ["parameters with comment signs", "answers that grow with the attempt"],
         ["use bound parameters", "filter at the proxy", "check the database's access log"],
         ["web-attack", "sql-injection", "database"]),
    14: ("Script code is placed in a page so that it runs in other visitors' browsers.",
         ["script tags or event handlers in parameters", "encoded angle brackets"],
         ["requests that carry script text", "redirects to unknown sites"],
         ["encode output", "restrict script sources by policy", "protect cookies from scripts"],
         ["web-attack", "cross-site-scripting", "javascript"]),
}


def entries():
    """Plain rows of the knowledge base in class order."""
    rows = []
    for i, name in LABELS.items():
        category, severity = CATEGORY[i]
        description, indicators, iocs, actions, tags = NOTES[i]
        rows.append({
            "attack_id": i, "attack_name": name, "category": category, "severity": severity,
            "description": description,
            "techniques": [f"{c} - {TECHNIQUE_NAMES[c]}" for c in TECHNIQUES[i]],
            "zeek_indicators": indicators, "network_iocs": iocs, "response_actions": actions,
            "mitre_tactics": TACTICS[i], "tags": tags,
        })
    return rows


def knowledge_base(spark):
    """The knowledge base as a table of 15 rows."""
    rows = entries()
    texts = pa.list_(pa.string())
    kinds = {
        "attack_id": pa.int32(), "attack_name": pa.string(), "category": pa.string(),
        "severity": pa.string(), "description": pa.string(),
    }
    return small_table(spark, {
        name: (kinds.get(name, texts), [r[name] for r in rows]) for name in rows[0]
    })


def technique_truth(spark):
    texts = pa.list_(pa.string())
    return small_table(spark, {
        "attack_id": (pa.int32(), list(TRUTH)),
        "true_name": (pa.string(), [LABELS[i] for i in TRUTH]),
        "true_tactics": (texts, [t for t, _ in TRUTH.values()]),
        "true_techniques": (texts, [t for _, t in TRUTH.values()]),
    })
