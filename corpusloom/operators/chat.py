"""Row operators that ask a language model, behind interchangeable providers.

A provider says how a model is reached; a ``ChatRows`` backend says what is asked and what
becomes of the answer.  Without a network the rule models at the end answer instead: they
read nothing but the prompt, so they exercise the same path as a real model.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd

from ..sources.adapters import CONFIDENCE, ENTITY_TYPES, FRAMES

Send = Callable[[str, str, dict], Any]

TEXT = {"type": "string"}
MAYBE = {"type": ["string", "null"]}
FLAG = {"type": "boolean"}


def record(**fields: dict) -> dict:
    """The schema of an object all of whose fields are required."""
    return {"type": "object", "properties": fields, "required": list(fields)}


def listed(item: dict) -> dict:
    return {"type": "array", "items": item}


def one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


JUDGEMENT = record(classification=one_of("0", "1"), reason=TEXT, company=TEXT)
KNOWLEDGE = record(
    entities=listed(record(id=TEXT, name=TEXT, type=one_of(*ENTITY_TYPES), confidence=one_of(*CONFIDENCE))),
    relations=listed(record(id=TEXT, subject=TEXT, relation=TEXT, object=TEXT, evidence=TEXT, confidence=one_of(*CONFIDENCE))),
    events=listed(record(id=TEXT, type=TEXT, trigger=TEXT, arguments={"type": "object"}, confidence=one_of(*CONFIDENCE))),
)
FRAMING = record(frames=listed(record(frame=TEXT, present=FLAG, evidence=TEXT)))
ARGUMENTS = record(arguments=listed(record(sentence=TEXT, claimant=MAYBE, argument_type=TEXT, target=MAYBE)))
LINK = record(canonical=TEXT, is_new=FLAG)
NAMED_TYPE = record(canonical=TEXT, description=TEXT)

_KINDS: dict[str, type | tuple] = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def check(value: Any, schema: dict, at: str = "answer") -> None:
    """Raise ValueError where ``value`` breaks ``schema`` (the part of JSON Schema used here)."""
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    if not any(isinstance(value, _KINDS[k]) for k in kinds):
        raise ValueError(f"{at} is not {' or '.join(kinds)}")
    if "enum" in schema and value not in schema["enum"]:
        raise ValueError(f"{at} is none of {', '.join(schema['enum'])}")
    for name in schema.get("required", ()):
        if name not in value:
            raise ValueError(f"{at}.{name} is missing")
    for name, inner in schema.get("properties", {}).items():
        check(value[name], inner, f"{at}.{name}")
    for k, item in enumerate(value if "items" in schema else ()):
        check(item, schema["items"], f"{at}[{k}]")


def unfence(text: str) -> str:
    """The inside of a fenced code block, or the text itself."""
    found = re.fullmatch(r"\s*```[A-Za-z]*\n?(.*?)\n?```\s*", text, re.DOTALL)
    return found[1] if found else text


@dataclass(frozen=True)
class Provider:
    """``connect`` runs once a worker and gives ``send(system, prompt, schema)``; ``pause`` seconds follow each call."""

    connect: Callable[[], Send]
    pause: float = 0.0
    fenced: bool = False

    def open(self) -> Send:
        send = self.connect()

        def ask(system: str, prompt: str, schema: dict) -> Any:
            answer = send(system, prompt, schema)
            time.sleep(self.pause)
            if isinstance(answer, str):
                answer = json.loads(unfence(answer) if self.fenced else answer)
            check(answer, schema)
            return answer

        return ask


def text_api(connect: Callable[[], Send], pause: float = 0.5) -> Provider:
    """A remote service that answers in text, perhaps fenced."""
    return Provider(connect, pause, fenced=True)


def object_api(connect: Callable[[], Send], pause: float = 0.5) -> Provider:
    """A remote service that answers with parsed objects."""
    return Provider(connect, pause)


def local_model(connect: Callable[[], Send]) -> Provider:
    """A model on the worker, which answers in JSON and needs no pacing."""
    return Provider(connect)


class ChatRows:
    """Asks for each row by itself; a row that fails keeps its key, null values and the error."""

    schema = ""
    answer: dict = {}
    system = ""
    key = "id"

    def __init__(self, provider: Provider, system: str | None = None):
        self.provider = provider
        self.system = self.system if system is None else system

    def open(self) -> None:
        self.ask = self.provider.open()

    def prompt(self, row: Any) -> str:
        raise NotImplementedError

    def result(self, answer: Any) -> dict | None:
        """Columns of an answer; None leaves the row out."""
        raise NotImplementedError

    def failed(self, error: str) -> dict:
        return {}

    def process(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            try:
                got, error = self.result(self.ask(self.system, self.prompt(row), self.answer)), None
            except Exception as e:
                got, error = self.failed(str(e)), str(e)
            if got is not None:
                out.append({self.key: row[self.key], **got, "error": error})
        names = [c.split()[0] for c in self.schema.split(", ")]
        return pd.DataFrame(out, columns=[*names, "error"], dtype=object)


class _Article(ChatRows):
    def prompt(self, row: Any) -> str:
        return f"Article:\n{row['body'] or ''}"


class Judge(_Article):
    """Is the article relevant, why, and which company does it name?  A failure is the class ERROR."""

    schema = "id long, llm_class string, llm_reason string, llm_company string"
    answer = JUDGEMENT
    system = "Decide whether the article reports a social conflict with a mining company: 1 if so, else 0. Give a reason of one line and the company's name, or an empty text. Answer in JSON."

    def result(self, answer: Any) -> dict:
        return {"llm_class": answer["classification"], "llm_reason": answer["reason"].replace("\n", " "), "llm_company": answer["company"].replace("\n", " ")}

    def failed(self, error: str) -> dict:
        return {"llm_class": "ERROR", "llm_reason": error, "llm_company": ""}


class Extractor(_Article):
    """Entities, relations and events as JSON text; a failure has three empty lists."""

    schema = "id long, entities string, relations string, events string"
    answer = KNOWLEDGE
    system = "List the entities, relations and events of the article in JSON. Relations and event roles point at entities by id."

    def result(self, answer: Any) -> dict:
        return {k: json.dumps(answer[k], ensure_ascii=False) for k in ("entities", "relations", "events")}

    def failed(self, error: str) -> dict:
        return {k: "[]" for k in ("entities", "relations", "events")}


class Framer(_Article):
    """Each frame with its evidence, the last answer for a frame counting; a failure has nulls."""

    schema = "id long, " + ", ".join(f"frame_{f} boolean, frame_{f}_evidence string" for f in FRAMES)
    answer = FRAMING
    system = f"Say of each frame ({', '.join(FRAMES)}) whether the article stresses it, with a short quotation. Answer in JSON."

    def result(self, answer: Any) -> dict:
        return {k: v for f in answer["frames"] for k, v in ((f"frame_{f['frame']}", f["present"]), (f"frame_{f['frame']}_evidence", f["evidence"]))}


class Miner(_Article):
    """The article's explicit arguments as JSON text; an article without any has no row."""

    schema = "id long, arguments string"
    answer = ARGUMENTS
    system = "List the sentences that argue explicitly, each with its kind, who claims it and at whom it is aimed, null if unsaid. Answer in JSON."

    def result(self, answer: Any) -> dict | None:
        found = answer["arguments"]
        return {"arguments": json.dumps(found, ensure_ascii=False)} if found else None


class _Canon(ChatRows):
    """A canonicaliser of clusters: its prompts are made by expressions before it (``canon``)."""

    key = "cluster_id"

    def prompt(self, row: Any) -> str:
        return row["prompt"]

    def result(self, answer: Any) -> dict:
        return {k: answer[k] for k in self.answer["required"]}


class Linker(_Canon):
    schema = "cluster_id string, canonical string, is_new boolean"
    answer = LINK
    system = "Give the fullest formal name of the entity that the mentions share, and whether it is too local to be in a public knowledge base. Answer in JSON."


class RelationNamer(_Canon):
    schema = "cluster_id string, canonical string, description string"
    answer = NAMED_TYPE
    system = "Name the relation that the expressions share, in capitals as VERB_PREPOSITION, and describe it briefly. Answer in JSON."


class EventNamer(_Canon):
    schema = "cluster_id string, canonical string, description string"
    answer = NAMED_TYPE
    system = "Name the kind of event that the types share, as Category.Type, and describe it briefly. Answer in JSON."


# -- rule models: deterministic answers from the prompt alone ---------------------


def _lines(prompt: str, title: str) -> list[str]:
    """The values of the line ``title: a | b``."""
    return next((x[len(title) + 2 :].split(" | ") for x in prompt.split("\n") if x.startswith(f"{title}: ")), [])


def keyword_rules(words: tuple[str, ...]) -> Send:
    def send(system: str, prompt: str, schema: dict) -> dict:
        low = prompt.removeprefix("Article:\n").lower()
        hit = next((w for w in words if w in low), None)
        return {"classification": "1" if hit else "0", "reason": f"mentions {hit}" if hit else "no keyword", "company": ""}

    return send


def _names(prompt: str) -> list[str]:
    import regex

    return list(dict.fromkeys(regex.findall(r"\p{Lu}\p{Ll}{3,}", prompt.removeprefix("Article:\n"))))[:8]


def knowledge_rules(system: str, prompt: str, schema: dict) -> str:
    """Capitalised words as entities, neighbours as relations, every third as an event: the view of the adapters."""
    names = _names(prompt)
    entity, level = (lambda k: f"e{k:03d}"), (lambda x: CONFIDENCE[len(x) % len(CONFIDENCE)])
    n = len(names)
    out: dict[str, list] = {"entities": [], "relations": [], "events": []}
    for k, x in enumerate(names, 1):
        out["entities"].append({"id": entity(k), "name": x, "type": ENTITY_TYPES[len(x) % len(ENTITY_TYPES)], "confidence": level(x)})
        if k < n:
            out["relations"].append({"id": f"r{k:03d}", "subject": entity(k), "relation": x.lower()[:3], "object": "e999" if k % 7 == 0 else entity(k + 1), "evidence": f"{x} {names[k]}", "confidence": level(x)})
        if k % 3 == 0:
            roles = {"actor": entity(k)} | ({"lugar": entity(k + 1)} if k < n else {}) | {"otro": "e999"}
            out["events"].append({"id": f"ev{k:03d}", "type": x.lower()[:4], "trigger": x.lower(), "arguments": roles, "confidence": level(x)})
    return json.dumps(out, ensure_ascii=False)


def argument_rules(system: str, prompt: str, schema: dict) -> str:
    names, kinds = _names(prompt), ("claim", "premise", "rebuttal", "proposal")
    target = lambda k: None if k % 2 else "ZZZ" if k % 4 == 0 else names[k] if k < len(names) else None
    return json.dumps({"arguments": [{"sentence": f"says {x}", "claimant": x.upper(), "argument_type": kinds[k % 4], "target": target(k)} for k, x in enumerate(names, 1)]}, ensure_ascii=False)


def frame_rules(tokens: dict[str, str]) -> Send:
    def send(system: str, prompt: str, schema: dict) -> str:
        low = prompt.removeprefix("Article:\n").lower()
        return json.dumps({"frames": [{"frame": f, "present": t in low, "evidence": t if t in low else ""} for f, t in tokens.items()]})

    return send


def link_rules(system: str, prompt: str, schema: dict) -> str:
    """The longest name, of equal ones the smallest; new where its length is even."""
    best = min(_lines(prompt, "Names"), key=lambda x: (-len(x), x))
    return json.dumps({"canonical": best, "is_new": len(best) % 2 == 0}, ensure_ascii=False)


def relation_rules(system: str, prompt: str, schema: dict) -> str:
    first = min(_lines(prompt, "Expressions"))
    return json.dumps({"canonical": "_".join([*first.upper().split(), "A"]), "description": f"relation {first}"}, ensure_ascii=False)


def event_rules(system: str, prompt: str, schema: dict) -> str:
    first = min(_lines(prompt, "Types"))
    return json.dumps({"canonical": f"Event.{first[:1].upper()}{first[1:]}", "description": f"event {first}"}, ensure_ascii=False)
