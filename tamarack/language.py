"""An optional language layer: briefs under a token budget, backends behind a protocol, and a verifier of what they claim.

The model sees a brief of findings only.  Each claim must cite findings of the brief, and may name no address, domain or
port that they don't.  Verification also runs as a DataFrame query over many incidents at once.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5
_ENTITY = r"\b(?:\d{1,3}(?:\.\d{1,3}){3}|(?:[a-z0-9-]+\.)+[a-z]{2,})\b"
_PORT = r"(?i)\bports?\s+(\d{1,5})\b"


def estimate_tokens(text: str) -> int:
    return int(len(text) / CHARS_PER_TOKEN) + 1


@dataclass(frozen=True)
class Brief:
    incident_id: str
    text: str
    citable: frozenset[str]
    truncated: bool


def build_brief(incident: dict, budget: int = 700, max_findings: int = 12) -> Brief:
    """An incident in few words: every finding's line first, then measurements while the budget lasts."""
    head = "\n".join([f"SUBJECT: {incident['subject']['value']}", f"PRIORITY: {incident['priority']:.2f}", f"BEHAVIOURS: {', '.join(incident['corroborating_predicates'])}", "", "FINDINGS (cite these ids and no others):"])
    parts, spent, cited, cut = [head], estimate_tokens(head), [], False
    for f in incident["findings"][:max_findings]:
        target = f" {f['object']['value']}" if f["object"] else ""
        line = f"  [{f['id']}] {f['subject']['value']} {f['predicate']}{target} (confidence {f['confidence']:.2f}, {f['severity']})"
        if spent + estimate_tokens(line) > budget:
            cut = True
            break
        spent += estimate_tokens(line)
        parts.append(line)
        cited.append(f)
    for f in cited:
        line = "\n".join(f"  [{f['id']}] {e['summary']}" for e in f["evidence"])
        if spent + estimate_tokens(line) > budget:
            cut = True
            break
        spent += estimate_tokens(line)
        parts.append(line)
    return Brief(incident["id"], "\n".join(parts), frozenset(f["id"] for f in cited), cut)


class Backend(Protocol):
    """Anything that completes a prompt to JSON with narrative, claims [{text, cites}] and actions."""

    def complete(self, prompt: str) -> str: ...


class Unavailable:
    """No model: every incident keeps its findings and gets no narrative."""

    def complete(self, prompt: str) -> str:
        return ""


@dataclass
class Scripted:
    """Fixed answers in turn, for tests."""

    answers: list[str]
    asked: list[str] = field(default_factory=list)

    def complete(self, prompt: str) -> str:
        self.asked.append(prompt)
        return self.answers.pop(0) if self.answers else ""


def entities_in(text: str) -> tuple[set[str], set[str]]:
    plain = text.lower()
    return set(re.findall(_ENTITY, plain)), set(re.findall(_PORT, plain))


def vocabulary(findings: list[dict]) -> tuple[set[str], set[str]]:
    """Names and ports that findings mention: entities, ports in payloads, and what artifacts quote."""
    names, ports = set(), set()
    for f in findings:
        for e in (f["subject"], f["object"]):
            if e:
                (ports if e["value"].isdigit() else names).add(e["value"].lower())
        for ev in f["evidence"]:
            ports |= {str(v) for k, v in json.loads(ev["payload"]).items() if "port" in k and v is not None}
            for a in ev["artifacts"]:
                found = entities_in(a["excerpt"] or "")
                names |= found[0]
                ports |= found[1]
    return names, ports


@dataclass
class Report:
    narrative: str
    claims: list[tuple[str, list[str], str | None]]  # text, cites, why it was struck
    actions: list[str]
    narrative_struck: bool = False


def verify(answer: dict, findings: list[dict], citable: frozenset[str]) -> Report:
    """Strike claims without citation, with one that wasn't shown, or that name what the cited findings don't."""
    by_id = {f["id"]: f for f in findings}
    claims = []
    for raw in answer.get("claims") or []:
        text, cites = str(raw.get("text", "")).strip(), [str(c) for c in raw.get("cites") or []]
        if not text:
            continue
        why = None
        missing = sorted(set(cites) - citable)
        if not cites:
            why = "no citation"
        elif missing:
            why = f"unresolved citation: {', '.join(missing)}"
        else:
            names, ports = vocabulary([by_id[c] for c in cites if c in by_id])
            said = entities_in(text)
            invented = sorted((said[0] - names) | (said[1] - ports))
            why = f"fabricated entity: {', '.join(invented)}" if invented else None
        claims.append((text, cites, why))
    narrative = str(answer.get("narrative") or "")
    names, ports = vocabulary(findings)
    said = entities_in(narrative)
    struck = bool((said[0] - names) | (said[1] - ports))
    return Report("" if struck else narrative, claims, [str(a) for a in answer.get("actions") or []], struck)


def reason(incidents: list[dict], backend: Backend, limit: int = 5, budget: int = 700) -> dict[str, Report]:
    """Reports of the first incidents of a queue, by id; an answer that isn't JSON gives none."""
    out = {}
    for incident in incidents[:limit]:
        brief = build_brief(incident, budget)
        try:
            answer = json.loads(backend.complete(brief.text))
        except ValueError:
            continue
        out[incident["id"]] = verify(answer, incident["findings"], brief.citable)
    return out


def struck_claims(claims: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """claims (claim, text, cites) with reason, null if it stands; vocabulary: (finding, name) of all findings shown.

    Citations and named entities are exploded and anti-joined, so any number of incidents is verified in one query.
    """
    known = vocabulary.select("finding").distinct()
    cited = claims.select("claim", F.explode("cites").alias("finding"))
    missing = cited.join(known, "finding", "left_anti").select("claim").distinct().withColumn("missing", F.lit(True))
    named = claims.select("claim", F.explode(F.array_union(F.regexp_extract_all(F.lower("text"), F.lit(f"({_ENTITY})"), F.lit(1)), F.regexp_extract_all("text", F.lit(_PORT), F.lit(1)))).alias("name"))
    allowed = cited.join(vocabulary, "finding").select("claim", F.lower("name").alias("name")).distinct()
    invented = named.join(allowed, ["claim", "name"], "left_anti").groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("invented"))
    rows = claims.join(missing, "claim", "left").join(invented, "claim", "left")
    why = F.when(F.coalesce(F.size("cites"), F.lit(0)) < 1, "no citation").when(F.col("missing"), "unresolved citation").when(F.col("invented").isNotNull(), F.concat(F.lit("fabricated entity: "), F.col("invented")))
    return rows.select("claim", "text", "cites", why.alias("reason"))
