"""Synthetic annotated workloads.

Every value is drawn by a hash of (seed, row, slot), so any row can be made alone, on any executor.
Templates and pools are our own; sizes and seeds are those of the published corpus, except that its
second workload is not published, so ours stands in for it.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .io import SAMPLE

# Number of samples and seed of each workload.
SIZES = {"wl1_pii": (500, 42), "wl2_secrets": (300, 43), "wl3_implicit": (200, 44), "wl4_code": (300, 45)}

POOLS = {
    "first": "Ada Bruno Celia Dmitri Edda Farid Greta Hugo Ilka Jonas Kamala Lior Mina Nils Oona Pavel Rosa Sami Tove Uri".split(),
    "last": "Ahlgren Bakshi Corvino Dahl Ebert Ferrand Grau Holm Ito Jurek Kessler Lund Moreau Novak Okafor Perrin Rossi Silva Toth Vance".split(),
    "domain": "mail.example post.example inbox.test office.test".split(),
    "company": ["Brightwater Labs", "Cobalt Ridge", "Evenfall Systems", "Lindenhof AG", "Orchard & Vale", "Quayside Analytics"],
    "project": ["Blue Heron", "Copperfield", "Driftwood", "Longshore", "Nightjar", "Windlass"],
    "team": ["payments platform", "search quality", "site operations", "data protection", "onboarding"],
    "street": ["Alder Street", "Canal Road", "Harbour Lane", "Mill Avenue", "Station Road", "Vine Court"],
    "city": ["Ashby", "Fenwick", "Marlow", "Northam", "Saltby", "Wexcombe"],
    "env": "prod staging dev".split(),
    "noun": "ledger profile invoice session audit roster".split(),
    "verb": "sync load merge validate rotate export".split(),
}
KIND_OF_SLOT = {
    "person": "person",
    "other": "person",
    "email": "email",
    "phone": "phone",
    "address": "address",
    "ssn": "ssn",
    "employee": "employee_id",
    "company": "org_name",
    "ip": "ip_address",
    "host": "hostname",
    "awsid": "aws_access_key",
    "awskey": "aws_secret_key",
    "apikey": "api_key",
    "password": "password",
    "token": "token",
    "project": "project_name",
    "function": "internal_function",
    "database": "database_name",
    "tablename": "table_name",
    "implicit": "implicit",
}

TEMPLATES = {
    "wl1_pii": [
        "Could you mail the signed form to {person} ({email})?", "{person} moved to {address}.\nNew phone: {phone}.", "Payroll needs the number of {person}: {ssn}, badge {employee}.",
        "Hi team,\n{person} and {other} from {company} visit on Monday. Ring {phone}.", "Contact: {person} <{email}>, {phone}", "Ship the replacement to {person}, {address}.",
        "Login from {ip} on {host} by {email} was refused.", "Please merge the accounts {email} and {employee}.", "My name is {person}, my SSN is {ssn}, can you check my refund?",
        "{other} will cover for {person} ({employee}) at {company}.", "Invoice address: {company}, {address}", "Visitor: {person}\nHost: {other}\nPhone: {phone}",
        "Why was {email} removed from the list of {company}?", "Escalate to {person}, {phone}, before noon.", "Record {employee}: {person}, {address}, {phone}.",
        "The scanner at {ip} flagged the laptop of {person}.", "Reply to {email} and copy {other}.", "Summarise the complaint of {person} ({company}) in two lines.",
    ],
    "wl2_secrets": [
        "export AWS_ACCESS_KEY_ID={awsid}\nexport AWS_SECRET_ACCESS_KEY={awskey}", "db:\n  host: {host}\n  password: {password}", "client = Client(api_key='{apikey}')",
        "curl -H 'Authorization: Bearer {token}' https://{host}/v1/items", "The share {host} uses the password {password}.", "API_KEY={apikey}  # rotate monthly",
    ],
    "wl3_implicit": [
        "Do not quote {implicit} in the notes.", "Ask {implicit} before the launch.", "The story came from {implicit}.", "Keep {implicit} out of the summary.", "Who is {implicit}?",
        "The memo mentions {implicit}.", "Rewrite this so that {implicit} is not recognisable.",
    ],
    "wl4_code": [
        "# {project}, {company}\ndef {function}(row_id):\n    return fetch('{database}', row_id)", "CREATE TABLE {tablename} (id BIGINT, owner TEXT); -- {company}", "connect(host='{host}', db='{database}')",
        "// TODO({person}): call {function} for {project}", "log.info('reply from {ip}')\n{function}()", "SELECT * FROM {tablename} WHERE mail = '{email}'", "api_key: {apikey}\nservice: {project}",
        "def {function}(x):\n    \"\"\"Used by {company}.\"\"\"\n    return x", "INSERT INTO {tablename} VALUES ('{email}', '{ip}')", "host = '{host}'\nkey = '{apikey}'", "class {project_class}:\n    table = '{tablename}'",
    ],
}
IMPLICIT = [
    f"{who} {what}" for who in ("the director", "the nurse", "the auditor", "the founder", "the engineer", "the translator", "the goalkeeper") for what in (
        "who left {company} after the merger", "on the {team} team with the blue boat", "from {city} whose twin runs the clinic",
    )
]
_CHARS = string.ascii_letters + string.digits


class _Draw:
    def __init__(self, seed: int, row: int) -> None:
        self.seed, self.row, self.n = seed, row, 0

    def number(self, below: int) -> int:
        self.n += 1
        return int.from_bytes(hashlib.blake2b(f"{self.seed}|{self.row}|{self.n}".encode(), digest_size=8).digest(), "big") % below

    def pick(self, pool):
        return pool[self.number(len(pool))]

    def chars(self, n: int, pool: str = _CHARS) -> str:
        return "".join(self.pick(pool) for _ in range(n))


def _slot(name: str, d: _Draw) -> str:
    p, num = POOLS, d.number
    if name in ("person", "other"):
        return f"{d.pick(p['first'])} {d.pick(p['last'])}"
    if name == "email":
        return f"{d.pick(p['first'])}.{d.pick(p['last'])}@{d.pick(p['domain'])}".lower()
    if name == "phone":
        a, b, c = 200 + num(800), 555, f"{num(10000):04d}"
        return d.pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}"])
    if name == "address":
        return f"{1 + num(9999)} {d.pick(p['street'])}, {d.pick(p['city'])}, {d.pick(['CA', 'NY', 'TX', 'WA'])} {10000 + num(89999)}"
    if name == "implicit":
        return d.pick(IMPLICIT).format(company=d.pick(p["company"]), team=d.pick(p["team"]), city=d.pick(p["city"]))
    simple = {
        "ssn": lambda: f"{900 + num(100)}-{10 + num(90)}-{1000 + num(9000)}", "employee": lambda: f"EMP-{10000 + num(90000)}", "ip": lambda: f"203.0.113.{1 + num(254)}",
        "host": lambda: f"{d.pick(p['noun'])}-{num(100):02d}.internal", "awsid": lambda: "AKIA" + d.chars(
            16, string.ascii_uppercase + string.digits,
        ), "awskey": lambda: d.chars(40, _CHARS + "/+"),
        "apikey": lambda: d.chars(24 + num(25)), "password": lambda: d.chars(
            12 + num(13), _CHARS + "!#%_",
        ), "token": lambda: d.chars(40 + num(41)), "database": lambda: f"{d.pick(p['noun'])}_{d.pick(p['env'])}",
        "function": lambda: f"_{d.pick(p['verb'])}_{d.pick(p['noun'])}", "tablename": lambda: f"{d.pick(p['noun'])}_t{1 + num(99)}", "project_class": lambda: d.pick(p["project"]).title().replace(" ", ""),
    }
    return simple[name]() if name in simple else d.pick(p[name])


def occurrences(text: str, value: str) -> Iterator[tuple[int, int]]:
    """All non-overlapping places of a value."""
    at = text.find(value) if value else -1
    while at >= 0:
        yield at, at + len(value)
        at = text.find(value, at + len(value))


def sample(workload: str, row: int, seed: int) -> tuple[str, list[dict]]:
    d = _Draw(seed, row)
    template = TEMPLATES[workload][row % len(TEMPLATES[workload])]
    values = {s: _slot(s, d) for s in dict.fromkeys(re.findall(r"{(\w+)}", template))}
    text = template.format(**values)
    marks = [
        {"start": a, "end": b, "kind": KIND_OF_SLOT[s], "text": v} for s, v in values.items() if s in KIND_OF_SLOT for a, b in occurrences(text, v)
    ]
    return text, marks


def generate(spark: SparkSession, workload: str, n: int | None = None, seed: int | None = None) -> DataFrame:
    """(id, text, annotations)."""
    size, own = SIZES[workload]
    n, seed, short = size if n is None else n, own if seed is None else seed, workload.split("_")[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [sample(workload, int(i), seed) for i in pdf["id"]]
            yield pd.DataFrame({"id": [f"{short}_{i:04d}" for i in pdf["id"]], "text": [t for t, _ in made], "annotations": [m for _, m in made]})

    return spark.range(n).mapInPandas(run, SAMPLE)
