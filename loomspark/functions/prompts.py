"""System prompts that describe tools; every prompt is one expression of an array of JSON texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

# What the models were trained to read. {system}, {tools} and {names} are filled in.
REACT_EN = """Answer the following questions as best you can. You have access to the following tools:

{tools}

Use the following format:

Question: the input question you must answer
Thought: you should always think about what to do
Action: the action to take, should be one of [{names}]
Action Input: the input to the action
Observation: the result of the action
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Thought: I now know the final answer
Final Answer: the final answer to the original input question

Begin!
"""
REACT_ZH = """尽可能地回答以下问题。你可以使用以下工具:

{tools}

请按照以下格式进行:

Question: 需要你回答的输入问题
Thought: 你应该总是思考该做什么
Action: 需要使用的工具，应该是[{names}]中的一个
Action Input: 传入工具的内容
Observation: 行动的结果
... (这个Thought/Action/Action Input/Observation可以重复N次)
Thought: 我现在知道最后的答案
Final Answer: 对原始输入问题的最终答案

现在开始！
"""
REACT_GRPO = """A conversation for tool calling between User and Assistant. The user asks a question which may be solved by calling tools, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process should be enclosed within <think> </think>tags and answer should follow the ReACT format(Action:xxx
Action Input:xxx), i.e., <think> reasoning process here </think> Action: action here
Action Input: parameters here

Answer the following questions as best as you can. You have access to the following tools:

{tools}

Use the following format:

<think>you should always think about what to do</think>
Action: the action to take, should be one of [{names}]
Action Input: the input to the action
Observation: the result of the action, given by the actual calling
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Final Answer: the final answer to the original input question

Begin!
"""
QWEN_EN = """{system}

# Tools

## You have access to the following tools:

{tools}

## When you need to call a tool, please insert the following command in your reply, which can be called zero or multiple times according to your needs:

✿FUNCTION✿: The tool to use, should be one of [{names}]
✿ARGS✿: The input of the tool
✿RESULT✿: Tool results
✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)"""
QWEN_ZH = """{system}

# 工具

## 你拥有如下工具：

{tools}

## 你可以在回复中插入零次、一次或多次以下命令以调用工具：

✿FUNCTION✿: 工具名称，必须是[{names}]之一。
✿ARGS✿: 工具输入
✿RESULT✿: 工具结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来"""
QWEN_EN_PARALLEL = """{system}

# Tools

## You have access to the following tools:

{tools}

## Insert the following command in your reply when you need to call N tools in parallel:

✿FUNCTION✿: The name of tool 1, should be one of [{names}]
✿ARGS✿: The input of tool 1
✿FUNCTION✿: The name of tool 2
✿ARGS✿: The input of tool 2
...
✿FUNCTION✿: The name of tool N
✿ARGS✿: The input of tool N
✿RESULT✿: The result of tool 1
✿RESULT✿: The result of tool 2
...
✿RESULT✿: he result of tool N
✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)"""
QWEN_ZH_PARALLEL = """{system}

# 工具

## 你拥有如下工具：

{tools}

## 你可以在回复中插入以下命令以并行调用N个工具：

✿FUNCTION✿: 工具1的名称，必须是[{names}]之一
✿ARGS✿: 工具1的输入
✿FUNCTION✿: 工具2的名称
✿ARGS✿: 工具2的输入
...
✿FUNCTION✿: 工具N的名称
✿ARGS✿: 工具N的输入
✿RESULT✿: 工具1的结果
✿RESULT✿: 工具2的结果
...
✿RESULT✿: 工具N的结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来"""
HERMES = """{system}

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{tools}
</tools>

For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{"name": <function-name>, "arguments": <args-json-object>}
</tool_call>"""
YOUTU = """{system}<|begin_of_tool_description|>Tool calling capabilities.
You may call one or more functions to assist with the user query. You have the following functions available:
{tools}
For tool call returns, you MUST use the following format:
<tool_call>{"name": "function-name", "arguments": {"param1": "value1", "param2": "value2"}}</tool_call>
<|end_of_tool_description|>"""
TOOLBENCH = """You can use many tools(functions) to do the following task.
First I will give you the task description, and your task start.
At each step, you need to give your thought to analyze the status now and what to do next, with a function call to actually execute your step. Your output should follow this format:
Thought:
Action:
Action Input:

After the call, you will get the call result, and you are now in a new state.
Then you will analyze your status now, then decide what to do next...
After many (Thought-call) pairs, you finally perform the task, then you can give your final answer.
Remember:
1.the state change is irreversible, you can't go back to one of the former state, if you want to restart the task, say "I give up and restart".
2.All the thought is short, at most in 5 sentence.
3.You can do more then one try, so if your plan is to continuously try some conditions, you can do one of the conditions per try.
Let's Begin!
Task description: You should use functions to help handle the real time user queries. Remember:
1.ALWAYS call "Finish" function at the end of the task. And the final answer should contain enough information to show to the user,If you can't handle the task, or you find that function calls always fail(the function is not valid now), use function Finish->give_up_and_restart.
2.Do not use origin tool names, use only subfunctions' names.
Specifically, you have access to the following APIs: {tools}"""
REACT_TOOL = {
    "en": "{name}: Call this tool to interact with the {human} API. What is the {human} API useful for? {about} Parameters: {parameters} Format the arguments as a JSON object.",
    "zh": "{name}: 调用此工具与 {human} API 进行交互。{human} 有什么用？{about} 输入参数：{parameters} 此工具的输入应为JSON对象。",
}
QWEN_TOOL = {
    "en": "### {human}\n\n{name}: {about} Parameters: {parameters} Format the arguments as a JSON object.",
    "zh": "### {human}\n\n{name}: {about} 输入参数：{parameters} 此工具的输入应为JSON对象。",
}
REACT = {"en": REACT_EN, "zh": REACT_ZH, "grpo": REACT_GRPO}
QWEN = {("en", False): QWEN_EN, ("zh", False): QWEN_ZH, ("en", True): QWEN_EN_PARALLEL, ("zh", True): QWEN_ZH_PARALLEL}


def filled(text: str, **values: Column) -> Column:
    """The text with each {name} replaced by the value of that name."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def spaced(compact: Column) -> Column:
    """Compact JSON with a space after each comma and colon outside of strings."""
    return F.regexp_replace(compact, r'\G((?:[^",:]++|"(?:[^"\\]++|\\.)*+")*+)([,:])', "$1$2 ")


def bare_tool(tool: Column) -> Column:
    """The function of a wrapped description, or the description, as compact JSON."""
    inner = F.when(F.get_json_object(tool, "$.type").isNotNull(), F.get_json_object(tool, "$.function"))
    return F.coalesce(inner, F.get_json_object(tool, "$"))


def wrapped_tool(tool: Column) -> Column:
    """A function description as {"type": "function", "function": ...} unless it is wrapped already."""
    whole, bare = spaced(F.get_json_object(tool, "$")), F.get_json_object(tool, "$.function").isNull() & F.get_json_object(tool, "$.type").isNull()
    return F.when(bare, F.concat(F.lit('{"type": "function", "function": '), whole, F.lit("}"))).otherwise(whole)


def _name(tool: Column) -> Column:
    given = F.get_json_object(tool, "$.name_for_model")
    return F.when(given != "", given).otherwise(F.get_json_object(tool, "$.name"))


def _described(tool: Column, form: str) -> Column:
    """A line of a bare tool; parameters given as text stay as they are."""
    human, parameters = F.get_json_object(tool, "$.name_for_human"), F.get_json_object(tool, "$.parameters")
    about = F.coalesce(F.get_json_object(tool, "$.description"), F.get_json_object(tool, "$.description_for_model"), F.lit("None"))
    text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(tool), "$.parameters", "variant")) == "STRING"
    shown = F.when(parameters.isNull() | parameters.isin("", "[]", "0", "false"), "{}").when(text, parameters).otherwise(spaced(parameters))
    return filled(form, name=_name(tool), human=F.when(human != "", human).otherwise(_name(tool)), about=about, parameters=shown)


def _listed(tools: Column, prompt: str, form: str, system: Column | None = None) -> Column:
    def text(bare: Column) -> Column:
        lines = F.array_join(F.transform(bare, lambda t: _described(t, form)), "\n\n")
        return filled(prompt, system=F.coalesce(system, F.lit("")) if system is not None else F.lit(""), tools=lines, names=F.array_join(F.transform(bare, _name), ","))

    return let(text, F.transform(tools, bare_tool))


def react_prompt(tools: Column, form: str = "en") -> Column:
    """Tools and the Action form; form is en, zh or grpo."""
    return _listed(tools, REACT[form], REACT_TOOL["zh" if form == "zh" else "en"])


def qwen_prompt(tools: Column, system: Column, parallel: bool = False, lang: str = "en") -> Column:
    """The system text, the tools and the keyword form; lang is en or zh."""
    return _listed(tools, QWEN[lang, parallel], QWEN_TOOL[lang], system)


def hermes_prompt(tools: Column, system: Column) -> Column:
    """The system text and wrapped tools inside tags."""
    return filled(HERMES, system=F.coalesce(system, F.lit("")), tools=F.array_join(F.transform(tools, wrapped_tool), "\n"))


def youtu_prompt(tools: Column, system: Column) -> Column:
    """The system text, if there is any, and wrapped tools in fences."""
    fenced = F.transform(tools, lambda t: F.concat(F.lit("```json\n"), wrapped_tool(t), F.lit("\n```")))
    return filled(YOUTU, system=F.when(system != "", F.concat(system, F.lit("\n\n"))).otherwise(""), tools=F.array_join(fenced, "\n"))


def toolbench_prompt(tools: Column) -> Column:
    """Bare tools as one JSON list."""
    listed = F.array_join(F.transform(tools, lambda t: spaced(bare_tool(t))), ", ")
    return filled(TOOLBENCH, tools=F.concat(F.lit("["), listed, F.lit("]")))
