"""Chat templates as expressions over message arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .delimit import stripped


@dataclass(frozen=True)
class Template:
    """Text around the turns; {{SYSTEM}}, {{QUERY}} and {{ROUND0}}/{{ROUND1}} are filled in."""

    name: str
    prompt: str
    chat_sep: str | None = ""
    suffix: str = ""
    prefix: str = ""
    system_prefix: str | None = None
    system_prompt: str | None = None
    tool_prompt: str = "{{QUERY}}"
    stop_words: tuple[str, ...] = field(default=())
    default_system: str | None = None

    def __post_init__(self):
        if "{{QUERY}}" not in self.prompt:
            raise ValueError("a prompt needs {{QUERY}}")
        if self.system_prefix is not None and "{{SYSTEM}}" not in self.system_prefix:
            raise ValueError("a system prefix needs {{SYSTEM}}")


def template_faults(prompt: Column, system_prefix: Column, prefix: Column) -> Column:
    """What is wrong with templates that a table holds, as Template() judges them: an array of faults, empty if none."""
    faults = F.array(
        F.when(~F.coalesce(prompt, F.lit("")).contains("{{QUERY}}"), "a prompt needs {{QUERY}}"), F.when(system_prefix.isNotNull() & ~system_prefix.contains("{{SYSTEM}}"), "a system prefix needs {{SYSTEM}}"),
        F.when(prefix.contains("{{SYSTEM}}"), "the prefix is for rows without a system"),
    )
    return F.array_compact(faults)


# Two public template formats.
CHATML = Template("chatml", "<|im_start|>user\n{{QUERY}}<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>\n", "<|im_end|>\n", "", "<|im_start|>system\n{{SYSTEM}}<|im_end|>\n")
PLAIN = Template("generate", "{{QUERY}}", "", "", "", "{{SYSTEM}}")
TEMPLATES = {t.name: t for t in (CHATML, PLAIN)}


def merged_turns(messages: Column) -> Column:
    """Neighbouring turns of one role become one turn, contents joined (tool turns by a line feed)."""
    empty = F.array().cast("array<struct<role:string,content:string>>")

    def step(done: Column, m: Column) -> Column:
        turn = F.struct(m["role"].alias("role"), m["content"].alias("content"))
        last = F.try_element_at(done, F.lit(-1))
        glue = F.when(m["role"] == "tool", F.lit("\n")).otherwise(F.lit(""))
        joined = F.struct(m["role"].alias("role"), F.concat(F.coalesce(last["content"], F.lit("")), glue, F.coalesce(m["content"], F.lit(""))).alias("content"))
        return F.when(last["role"] == m["role"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(turn)))

    return F.aggregate(messages, empty, step)


def merged_calls(messages: Column) -> Column:
    """Neighbouring tool_call turns become one assistant turn, joined by line feeds; tool_response becomes tool."""
    renamed = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "tool_response", "tool").otherwise(m["role"]).alias("role"), m["content"].alias("content")))
    empty = F.array().cast("array<struct<role:string,content:string>>")

    def step(done: Column, m: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(m["role"].alias("role"), F.concat_ws("\n", last["content"], m["content"]).alias("content"))
        return F.when((m["role"] == "tool_call") & (last["role"] == "tool_call"), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(m)))

    out = F.aggregate(renamed, empty, step)
    return F.transform(out, lambda m: F.struct(F.when(m["role"] == "tool_call", "assistant").otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def last_user(messages: Column) -> Column:
    """Index of the last user turn, -1 if there is none."""
    at = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(at), F.lit(-1))


def without_tail(messages: Column) -> Column:
    """Without the assistant turns at the end."""
    last = F.coalesce(F.array_max(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] != "assistant", i + 1)), lambda i: i.isNotNull())), F.lit(0))
    return F.slice(messages, 1, last)


def standardised(messages: Column) -> Column:
    """Pairs: a leading assistant turn gets an empty query, an open query a null answer."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.cast("string").alias("content"))
    plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    led = lambda p: F.when(F.get(p, 0)["role"] == "assistant", F.concat(F.array(turn("user", F.lit(""))), p)).otherwise(p)
    closed = lambda h: F.when(F.size(h) % 2 == 1, F.concat(h, F.array(turn("assistant", F.lit(None))))).otherwise(h)
    return let(lambda p: let(closed, led(p)), plain)


def system_of(messages: Column) -> tuple[Column, Column]:
    """The system text (null if none) and the messages without it."""
    head = F.get(messages, 0)["role"] == "system"
    return F.when(head, F.get(messages, 0)["content"]), F.when(head, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def without_old_thinking(messages: Column) -> Column:
    """Before the last user turn, answers keep only what follows their last </think>."""
    return let(lambda ms, last: F.transform(ms, lambda m, i: F.struct(m["role"].alias("role"), F.when((m["role"] == "assistant") & (i < last), stripped(F.element_at(F.split(m["content"], "</think>"), -1))).otherwise(m["content"]).alias("content"))), messages, last_user(messages))


def with_empty_thinking(messages: Column, prefix: str = "<think>\n\n</think>\n\n") -> Column:
    """Answers from the last user turn on start with the empty thinking text unless they think."""
    return let(lambda ms, last: F.transform(ms, lambda m, i: F.struct(m["role"].alias("role"), F.when((m["role"] == "assistant") & (i > last) & ~m["content"].startswith(prefix), F.concat(F.lit(prefix), m["content"])).otherwise(m["content"]).alias("content"))), messages, last_user(messages))


def parts(pairs: Column, system: Column, t: Template, training: bool = True) -> Column:
    """[(text, kind, round)] of a conversation in standardised pairs; kind is other, response or suffix."""
    return let(lambda p, s: _parts(p, s, t, training), pairs, system)


def _parts(pairs: Column, system: Column, t: Template, training: bool) -> Column:
    part = lambda text, kind, i: F.struct(text.alias("text"), F.lit(kind).alias("kind"), i.cast("int").alias("round"))
    rounds = (F.size(pairs) / 2).cast("int")
    starts = F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        q, r = F.get(pairs, i * 2), F.get(pairs, i * 2 + 1)
        ask = F.replace(F.replace(F.lit(t.prompt), F.lit("{{ROUND0}}"), i.cast("string")), F.lit("{{ROUND1}}"), (i + 1).cast("string"))
        if t.system_prompt:
            late = F.replace(F.lit(t.system_prompt), F.lit("{{SYSTEM}}"), F.coalesce(system, F.lit("")))
            ask = F.when(i == rounds - 1, late).otherwise(ask)
        head = F.when(q["role"] == "tool", F.replace(F.lit(t.tool_prompt), F.lit("{{QUERY}}"), q["content"])).otherwise(F.replace(ask, F.lit("{{QUERY}}"), q["content"]))
        out = F.array(part(head, "other", i))
        answered = F.concat(out, F.array(part(r["content"], "response", i)))
        sep = F.when(F.get(pairs, i * 2 + 2)["role"] != "tool", F.concat(answered, F.array(part(F.lit(t.chat_sep or ""), "other", i)))).otherwise(answered)
        stops = F.lit(False)
        for w in t.stop_words:
            stops = stops | r["content"].endswith(w)
        end = F.concat(answered, F.array(part(F.lit(t.suffix), "suffix", i))) if training else answered
        return F.when(i < rounds - 1, sep).when(r["content"].isNull(), out).when(stops, answered).otherwise(end)

    given = F.coalesce(system, F.lit(t.default_system).cast("string"))
    lead = F.lit(t.prefix) if t.system_prefix is None else F.when(F.coalesce(given, F.lit("")) != "", F.replace(F.lit(t.system_prefix), F.lit("{{SYSTEM}}"), given)).otherwise(F.lit(t.prefix))
    return F.concat(F.filter(F.array(part(lead, "other", F.lit(-1))), lambda p: p["text"] != ""), F.flatten(F.transform(starts, one)))


def rendered(messages: Column, t: Template = CHATML, training: bool = True) -> Column:
    """The whole conversation as text."""
    system, rest = system_of(messages)
    return F.array_join(F.transform(parts(standardised(merged_turns(rest)), system, t, training), lambda p: p["text"]), "")


# -- media -----------------------------------------------------------------------------------


def with_media_tags(text: Column, tag: str, count: Column) -> Column:
    """Tags that the text lacks are put before it."""
    have = F.regexp_count(text, F.lit(tag))
    return F.concat(F.repeat(F.lit(tag), F.greatest(count - have, F.lit(0)).cast("int")), text)


def inline_images(text: Column) -> tuple[Column, Column]:
    """<img>path</img> marks -> <image> tags, and the paths."""
    return F.regexp_replace(text, "(?s)<img>(.+?)</img>", "<image>"), F.regexp_extract_all(text, F.lit("(?s)<img>(.+?)</img>"), 1)


def scaled_box(box: Column, width: Column, height: Column, most: int = 1000) -> Column:
    """Coordinates in thousandths of the image, rounded half to even."""
    return F.transform(box, lambda v, i: F.bround(v / F.when(i % 2 == 0, width).otherwise(height) * most).cast("int"))


def box_text(box: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(box) / 2).cast("int") - 1), lambda i: F.concat(F.lit("("), F.get(box, i * 2).cast("string"), F.lit(","), F.get(box, i * 2 + 1).cast("string"), F.lit(")"))), ",")


def filled_tags(text: Column, tag: str, values: Column) -> Column:
    """The n-th tag becomes the n-th value; further tags stay."""
    joined = lambda cut, vs: F.aggregate(F.slice(F.transform(cut, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), 2, F.greatest(F.size(cut) - 1, F.lit(0))), F.get(cut, 0), lambda acc, x: F.concat(acc, F.coalesce(F.get(vs, x["i"] - 1), F.lit(tag)), x["p"]))
    return let(joined, F.split(text, tag.replace("|", r"\|")), values)


def resized(width: Column, height: Column, most: int, factor: int = 1) -> tuple[Column, Column]:
    """Width and height scaled down to at most most pixels."""
    ratio = F.sqrt(F.lit(float(most)) / (width * height))
    fit = lambda v: F.when(width * height > most, F.floor(v * ratio / factor) * factor).otherwise(v).cast("int")
    return fit(width), fit(height)


# File extensions by kind of media.
EXTENSIONS = {"image": "jpg jpeg png bmp gif tiff webp".split(), "video": "mp4 avi mov mkv webm flv wmv mpeg".split(), "audio": "mp3 wav ogg flac m4a aac".split()}


def media_kind(path: Column) -> Column:
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(names), kind).otherwise(out)
    return out


def source_kind(value: Column) -> Column:
    """url, data (a data URI), base64 or path."""
    return F.when(value.rlike("^https?://"), "url").when(value.startswith("data:"), "data").when((F.length(value) > 200) & value.rlike("^[A-Za-z0-9+/=]+$"), "base64").otherwise("path")
