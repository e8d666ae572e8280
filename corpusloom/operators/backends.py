"""Deterministic offline backends for model-shaped row operators."""

from __future__ import annotations

import pandas as pd

from ..sources.adapters import FRAME_TOKENS


class KeywordJudge:
    """Calls a text relevant when it holds one of its words."""

    schema = "id long, llm_class string, llm_reason string, llm_company string"

    def __init__(self, words: tuple[str, ...]):
        self.words = words

    def open(self) -> None:
        self.low = [w.lower() for w in self.words]

    def process(self, rows: pd.DataFrame) -> pd.DataFrame:
        hit = rows["body"].fillna("").str.lower().map(lambda t: next((w for w in self.low if w in t), None))
        return pd.DataFrame({"id": rows["id"], "llm_class": hit.notna().map({True: "1", False: "0"}), "llm_reason": hit.map(lambda w: f"mentions {w}" if w else "no keyword"), "llm_company": ""})


class TokenFrames:
    """A frame is present when its token is."""

    schema = "id long, " + ", ".join(f"frame_{f} boolean, frame_{f}_evidence string" for f in FRAME_TOKENS)

    def open(self) -> None:
        pass

    def process(self, rows: pd.DataFrame) -> pd.DataFrame:
        text = rows["body"].fillna("").str.lower()
        out = {"id": rows["id"]}
        for f, token in FRAME_TOKENS.items():
            here = text.str.contains(token, regex=False)
            out |= {f"frame_{f}": here, f"frame_{f}_evidence": here.map({True: token, False: ""})}
        return pd.DataFrame(out)


class LengthSentiment:
    """Two logits from a text's marks and length, for the softmax and threshold after it."""

    schema = "id long, logits array<double>"

    def open(self) -> None:
        pass

    def process(self, rows: pd.DataFrame) -> pd.DataFrame:
        text = rows["body"].fillna("")
        return pd.DataFrame({"id": rows["id"], "logits": [[float(len(t) % 7), float(t.count(","))] for t in text]})
