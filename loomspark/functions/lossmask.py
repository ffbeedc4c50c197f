"""Which text counts in the loss, and how much."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .delimit import by_keywords, by_patterns

# Weights by keyword (key, content) or by pattern (content).
REACT = {"Action:": (2.0, 2.0), "Action Input:": (2.0, 2.0), "Thought:": (1.0, 1.0), "Final Answer:": (1.0, 1.0), "Observation:": (2.0, 0.0)}
QWEN = {"✿FUNCTION✿:": (2.0, 2.0), "✿ARGS✿:": (2.0, 2.0), "✿RETURN✿:": (1.0, 1.0), "✿RESULT✿:": (2.0, 0.0)}
HERMES = {"<tool_call>.+?</tool_call>": (2.0,)}
EMPTY_THINK = {
    r"^<think>\s*</think>\s*": (0.0,),
    "^<seed:think><seed:cot_budget_reflect>The current thinking budget is 0, so I will directly start answering the question.</seed:cot_budget_reflect>\n</seed:think>\\s*": (0.0,),
    r"^</think>\s*": (0.0,),
}
FLAN = {
    "Name:": (1.0, 3.0), "Action:": (1.0, 3.0), "ACTION:": (1.0, 3.0), "Tool:": (1.0, 3.0), "Command": (1.0, 3.0), "Arguments:": (1.0, 3.0), "action input": (1.0, 3.0),
    "ACTION_INPUT:": (1.0, 3.0), "Action Input:": (1.0, 3.0), "Thought:": (1.0, 1.0), "Final Answer:": (1.0, 1.0), "Observation:": (2.0, 0.0),
}
FLAN_QUERY = {"What is the tool you want to use": 3.0, "What are the required parameter names": 3.0, "What is the value of": 3.0, "What are the required parameter names for this tool": 3.0}
MAPS = {"react": REACT, "alpha_umi": REACT, "qwen": QWEN, "hermes": HERMES, "ignore_empty_think": EMPTY_THINK, "agentflan": FLAN}
STRATEGIES = ("default", "last_round", "all")


def parse_spec(spec: str) -> tuple[str, str | None]:
    """"strategy", "map" or "strategy+map" -> (strategy, map name)."""
    first, _, rest = spec.partition("+")
    if first in STRATEGIES:
        name = rest or None
    else:
        first, name = "default", spec
    if name is not None and name not in MAPS:
        raise ValueError(f"unknown loss scale {name}")
    return first, name


def is_binary(name: str | None) -> bool:
    """Whether a map only uses the weights 0 and 1."""
    return name is None or all(w in (0.0, 1.0) for ws in MAPS[name].values() for w in ws)


def base_scale(kind: Column, round_: Column, loss: Column, last_round: Column, strategy: str) -> Column:
    """1 or 0 for a part: an explicit loss mark of the turn decides, else the strategy."""
    answer = kind.isin("response", "suffix")
    rule = {"all": F.lit(True), "default": answer, "last_round": answer & (round_ >= last_round)}[strategy]
    return F.when(loss.isNotNull() & (kind == "response"), (loss != 0).cast("double")).otherwise(rule.cast("double"))


def weighted(text: Column, name: str, query: Column | None = None, by_query: dict[str, float] | None = None) -> Column:
    """[(text, weight)] of a response under a map; a key found in the query overrides it whole."""
    table = MAPS[name]
    if name == "agentflan" and query is not None and by_query is None:
        by_query = FLAN_QUERY
    keys = [k for k, w in table.items() if len(w) == 2]
    pair = lambda t, w: F.struct(t.alias("text"), w.alias("weight"))

    def weight(key: Column, at: int) -> Column:
        out = F.lit(1.0)
        for k, w in table.items():
            out = F.when(key == k, F.lit(w[min(at, len(w) - 1)])).otherwise(out)
        return out

    if keys:
        cut = F.flatten(F.transform(by_keywords(text, keys), lambda p: F.when(p["key"] != "", F.array(pair(p["key"], weight(p["key"], 0)), pair(p["content"], weight(p["key"], 1)))).otherwise(F.array(pair(p["content"], F.lit(1.0))))))
    else:
        cut = F.transform(by_patterns(text, list(table)), lambda p: pair(p["content"], weight(p["key"], 0)))
    for key, w in (by_query or {}).items():
        cut = F.when(F.contains(query, F.lit(key)), F.array(pair(text, F.lit(float(w))))).otherwise(cut)
    return cut


def merged_weights(parts: Column) -> Column:
    """Neighbouring parts of equal weight become one."""
    empty = F.array().cast("array<struct<text:string,weight:double>>")

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(F.concat(last["text"], p["text"]).alias("text"), p["weight"].alias("weight"))
        return F.when(last["weight"] == p["weight"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, empty, step)
