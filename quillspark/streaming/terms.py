"""Term facts on a stream of sections: state for each (document, term), with a timeout.

Sections come in any order and split into batches in any way; after each batch the facts that it changed come out anew,
with a revision that counts the batches a term has changed in. The newest revision of each term is what
`operators.terms.term_facts` gives of all sections so far, also after a restart from the checkpoint. A term that
nothing changes for `idle` is closed: its last facts come out once more, marked, and its state goes, so
state is bounded by what is in work. A section that comes later opens it anew."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.terms import occurrences, scored

EMPTY = {"n": 0, "titles": [], "contexts": [], "definitions": [], "first": None, "revision": 0}


def added(state: dict, rows: pd.DataFrame) -> dict:
    """The state with more occurrences of its term."""
    s = {k: set(state[k]) for k in ("titles", "contexts", "definitions")}
    first = state["first"]
    for section, form, title, ctx, found in zip(rows["section_id"], rows["form"], rows["title"], rows["ctx"], rows["def"]):
        if title is not None:
            s["titles"].add(title)
        if ctx is not None:
            s["contexts"].add(ctx)
        if found is not None:
            s["definitions"].add(found)
            new = [int(section), form, found]
            first = new if first is None or new < first else first
    return {"n": state["n"] + len(rows), "first": first, "revision": state["revision"], **{k: sorted(v) for k, v in s.items()}}


def told(key: tuple, state: dict, closed: bool) -> pd.DataFrame:
    ctx = min(state["contexts"], key=lambda c: (len(c), c), default=None)
    row = (*key, state["n"], len(state["titles"]), len(state["contexts"]), len(state["definitions"]), state["first"][2] if state["first"] else None, ctx, ", ".join(state["titles"]), state["revision"], closed)
    return pd.DataFrame([row], columns=NAMES)


NAMES = ["doc_id", "term", "frequency", "n_sections", "n_contexts", "n_definitions", "definition", "context", "sections", "revision", "closed"]


def term_facts_stream(terms: DataFrame, idle: str | None = "1 hour") -> DataFrame:
    """The columns of term_facts, revision and closed, of streamed rows of section_terms; to be written in update mode.
    Without `idle` nothing is closed; a run over what is available now only ends that way, as timers keep a stream alive."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    kind = terms.schema["doc_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else EMPTY
        if state.hasTimedOut:
            state.remove()
            yield told(key, now, True)
            return
        for rows in batches:
            now = added(now, rows)
        now = now | {"revision": now["revision"] + 1}
        state.update((json.dumps(now),))
        if ms is not None:
            state.setTimeoutDuration(ms)
        yield told(key, now, False)

    out = f"doc_id {kind}, term string, frequency bigint, n_sections bigint, n_contexts bigint, n_definitions bigint, definition string, context string, sections string, revision int, closed boolean"
    facts = occurrences(terms).groupBy("doc_id", "term").applyInPandasWithState(step, out, "state string", "update", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
    return scored(facts)


def newest(facts: DataFrame) -> DataFrame:
    """The newest facts of each term of what the stream has written."""
    w = Window.partitionBy("doc_id", "term").orderBy(F.desc("revision"), F.desc("closed"))
    return facts.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "revision", "closed")
