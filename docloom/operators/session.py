"""The client's session: what each message of a user sets off, by a table of transitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions.text import strip

#: (phase, event) to (phase, action). Phases: new (no question yet), product and issue (what the client
#: waits for after it has asked back), talk. Events: what a message is in its phase.
TRANSITIONS = {
    ("new", "unclear"): ("product", "ask_product"),
    ("new", "clear"): ("talk", "query"),
    ("product", "no brand"): ("product", "ask_brand"),
    ("product", "brand"): ("issue", "ask_issue"),
    ("issue", "message"): ("talk", "query"),
    ("talk", "message"): ("talk", "query"),
    ("talk", "moved, unclear"): ("product", "ask_product"),
    ("talk", "moved, clear"): ("talk", "query"),
}
_OUT = "conv_id {0}, turn {1}, action string, query string, history int, category string, brand string, reset boolean"


def sessions(messages: DataFrame, unclear: Column | None = None, categories: R.Rules = R.CLIENT_CATEGORIES, brands: R.Rules = R.CLIENT_BRANDS, appliances: list[str] = R.CLIENT_APPLIANCES, questions: list[str] = R.CLIENT_QUESTIONS) -> DataFrame:
    """conv_id, turn, action, query, history, category, brand, reset of each message (conv_id, turn, text).

    action: none (a blank or null message), ask_product, ask_brand, ask_issue or query, with the query
    that is sent; history: messages that the session holds then; category and brand: what it takes the
    talk to be about; reset: whether the message has ended the talk before. unclear tells of a first
    question (an expression of text) that the server asks for the product; the test for new topics by
    default. Every query counts as answered. Messages go by turn, nulls first, equal turns by text.

    A session is folded as its messages stream by: a task holds the state of one session, of any length.
    """
    text = F.coalesce(strip("text"), F.lit(""))
    rows = messages.select("conv_id", "turn", text.alias("text"))
    asks = R.new_topic("text") if unclear is None else unclear
    rows = rows.select(
        "conv_id", "turn", "text", R.whole_word_category("text", categories).alias("category"), R.whole_word_category("text", brands).alias("brand"),
        F.coalesce(R.client_issue("text", appliances, questions), F.lit(False)).alias("issue"), F.coalesce(asks, F.lit(False)).alias("unclear"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "text")
    types = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    # null ids and turns pass pandas as strings
    passed = dealt.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    made = passed.mapInPandas(_folded(TRANSITIONS), _OUT.format("string", "string"))
    return made.withColumns({"conv_id": F.col("conv_id").cast(types[0]), "turn": F.col("turn").cast(types[1])})


class _Session:
    def __init__(self):
        self.phase, self.first, self.product, self.category, self.brand, self.history = "new", None, None, None, None, 0

    def event(self, m) -> str:
        if self.phase == "product":
            return "brand" if m.brand is not None else "no brand"
        clear = "unclear" if m.unclear else "clear"
        if self.phase == "new":
            return clear
        moved = self.phase == "talk" and m.issue and m.category is not None and self.category is not None and m.category != self.category
        return f"moved, {clear}" if moved else "message"

    def take(self, m, table: dict) -> tuple:
        if not m.text:
            return "none", None, self.history, self.category, self.brand, False
        event, phase = self.event(m), self.phase
        self.phase, action = table[phase, event]
        query = m.text if action == "query" else None
        if event.endswith("clear"):  # a question of its own: nothing of a talk before it counts
            self.first, self.product, self.category, self.brand, self.history = m.text, None, m.category, None, 0
        if event == "brand":
            self.product, self.brand = m.text, m.brand
        if phase == "issue":
            query = f"{m.text} ({self.product})"
        self.history += (event != "no brand") + (action == "query")  # the message, and the answer to a query
        return action, query, self.history, self.category, self.brand, event.startswith("moved")


def _folded(table: dict) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, of = None, object()
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            out = []
            for m in batch.itertuples(index=False):
                if m.conv_id != of:
                    state, of = _Session(), m.conv_id
                out.append((m.conv_id, m.turn, *state.take(m, table)))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "action", "query", "history", "category", "brand", "reset"])

    return run
