"""The one row shape all chat data is brought to, and the names it is recognised by."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("loss", T.DoubleType())])
PLAIN_MESSAGE = T.StructType(MESSAGE.fields[:2])
MESSAGES = T.ArrayType(MESSAGE)
IMAGES = T.ArrayType(T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())]))
OBJECTS = T.StructType([T.StructField("ref", T.ArrayType(T.StringType())), T.StructField("bbox", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("bbox_type", T.StringType()), T.StructField("image_id", T.ArrayType(T.LongType()))])

# Column names, roles and aliases of the data formats that are read.
ROLES = ("system", "user", "tool_call", "tool_response", "tool", "assistant")
PREFIXES = ("", "rejected_", "positive_", "negative_")
SYSTEM_NAMES = ("system", "system_prompt")
QUERY_NAMES = ("query", "prompt", "input", "instruction", "question", "problem")
RESPONSE_NAMES = ("response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text", "completion", "content")
MESSAGES_NAMES = ("messages", "conversation", "conversations")
USER_ROLES, ASSISTANT_ROLES = ("user", "human"), ("assistant", "gpt", "bot")
CALL_ROLES, REPLY_ROLES = ("function_call",), ("function_response", "observation", "observations")
MEDIA = ("images", "videos", "audios")

TYPES: dict[str, T.DataType] = {"messages": MESSAGES, "rejected_messages": MESSAGES, "positive_messages": T.ArrayType(T.ArrayType(PLAIN_MESSAGE)), "negative_messages": T.ArrayType(T.ArrayType(PLAIN_MESSAGE))}
for _p in PREFIXES:
    TYPES |= {f"{_p}images": IMAGES, f"{_p}videos": T.ArrayType(T.StringType()), f"{_p}audios": T.ArrayType(T.StringType()), f"{_p}objects": OBJECTS, f"{_p}tools": T.StringType()}
TYPES |= {"rejected_response": T.StringType(), "label": None, "channel": T.StringType(), "margin": T.DoubleType(), "solution": T.StringType()}
STANDARD = tuple(TYPES)
