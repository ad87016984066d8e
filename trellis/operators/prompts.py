"""Prompt construction and token-sequence operators (C*)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import arrays as AR
from trellis.functions.text import col, py_strip
from trellis.operators.sequence import running_sum

# The vision placeholder that replaces "<image>".
VISION_PLACEHOLDER = "<|vision_start|><|image_pad|><|vision_end|>"

# Evidence-format instruction used by the tuned models.
EVIDENCE_INSTRUCTION = (
    "You FIRST think about the reasoning process as an internal monologue and then provide the final answer. "
    "The reasoning process MUST BE enclosed within <think> </think> tags. WITHIN the thinking process, make "
    "reference to the relevant texts in the prompt that provide critical information to move the reasoning "
    "process forward. The referenced texts MUST BE enclosed within <retrieval> </retrieval> tags, and MUST BE "
    "placed within the reasoning process only. The final answer MUST BE put at the end of the response after "
    "\"Answer:\"."
)

# Header of the "### Human:" chat family.
HUMAN_HEADER = ("A chat between a curious human and an artificial intelligence assistant. "
                "The assistant gives helpful, detailed, and polite answers to the human's questions.\n\n")


def chat_messages(prompt, system: str | Column | None = None) -> Column:
    """``[system?, user]`` messages; the system message only when non-empty."""
    user = F.array(F.struct(F.lit("user").alias("role"), col(prompt).alias("content")))
    if system is None:
        return user
    s = system if isinstance(system, Column) else F.lit(system)
    sys_msg = F.array(F.struct(F.lit("system").alias("role"), s.alias("content")))
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(sys_msg, user)).otherwise(user)


def chatml(messages) -> Column:
    """A tokenizer chat template (ChatML form) with the generation prompt."""
    turns = F.transform(col(messages), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"),
                                                          m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))


def llama3(messages) -> Column:
    """The header form of the third Llama generation, with the generation prompt."""
    turns = F.transform(col(messages), lambda m: F.concat(F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n"),
                                                          m["content"], F.lit("<|eot_id|>")))
    return F.concat(F.lit("<|begin_of_text|>"), F.array_join(turns, ""), F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n"))


# System texts and wrappers of the chat families.
SYSTEM_TEXT = {"Qwen2.5": "You are Qwen, created by Alibaba Cloud. You are a helpful assistant.",
               "Llama": "You are Llama, created by Meta. You are a helpful assistant."}
VICUNA_HEADER = ("A chat between a curious user and an artificial intelligence assistant. "
                 "The assistant gives helpful, detailed, and polite answers to the user's questions.")
WRAPPERS = (  # the first whose name is part of the model's
    ("chatglm3", "<|user|>\n", "<|assistant|>"),
    ("chatglm", "[Round 1]\n\n\u95ee\uff1a", "\n\n\u7b54\uff1a"),
    ("longchat", VICUNA_HEADER + " USER: ", " ASSISTANT:"),
    ("vicuna", VICUNA_HEADER + " USER: ", " ASSISTANT:"),
    ("llama2", "[INST]", "[/INST]"),
    ("xgen", HUMAN_HEADER + " ### Human: ", "\n###"),
    ("internlm", "<|User|>:", "<eoh>\n<|Bot|>:"),
)


def render_chat(prompt, family: str, tuned_marker: str | None = None, templates: dict | None = None) -> Column:
    """Per-family chat wrapping.  Families with a system text go through a
    tokenizer template (``messages -> string``), which ``templates`` replaces by
    family.  A model whose name contains ``tuned_marker`` gets the evidence-format
    instruction in the system text; a ``no_syspmt`` model gets it before the
    prompt.  A model of no known family takes the prompt as it is."""
    p = col(prompt)
    for name, template in ({"Qwen2.5": chatml, "Llama": llama3} | (templates or {})).items():
        if name in family and "chatglm3" not in family:
            system = SYSTEM_TEXT[name]
            if tuned_marker and tuned_marker in family:
                system += " " + EVIDENCE_INSTRUCTION
            if "no_syspmt" in family:
                p = F.concat(F.lit(EVIDENCE_INSTRUCTION + "\n\n"), p)
            return template(chat_messages(p, system))
    for name, before, after in WRAPPERS:
        if name in family:
            return F.concat(F.lit(before), p, F.lit(after))
    return p


_SLOT = re.compile(r"\{(context|input)\}")


def fill_template(template: str, columns: dict[str, Column]) -> Column:
    """Fill ``{context}``/``{input}`` once; the template is parsed on the
    driver into literal pieces, so text holding ``{input}`` is never re-expanded."""
    parts, last = [], 0
    for m in _SLOT.finditer(template):
        parts.append(F.lit(template[last:m.start()]))
        parts.append(columns[m.group(1)])
        last = m.end()
    parts.append(F.lit(template[last:]))
    return F.concat(*parts)


def fill_by_dataset(dataset, templates: dict[str, str], columns: dict[str, Column]) -> Column:
    """C3 with the template chosen by the row's dataset."""
    out = None
    for name, tpl in templates.items():
        branch = fill_template(tpl, columns)
        out = F.when(col(dataset) == name, branch) if out is None else out.when(col(dataset) == name, branch)
    return out


def image_placeholder(prompt) -> Column:
    """``<image>`` → vision placeholder tokens."""
    return F.replace(col(prompt), F.lit("<image>"), F.lit(VISION_PLACEHOLDER))


def strip_markers(response, family: str, tuned_marker: str | None = None) -> Column:
    """C17: family post-processing of a generated answer."""
    r = col(response)
    if "xgen" in family:
        return F.replace(py_strip(r), F.lit("Assistant:"), F.lit(""))
    if "internlm" in family:
        return F.split_part(r, F.lit("<eoa>"), F.lit(1))
    if "Qwen2.5" in family or "Llama" in family:
        r = F.when(r.endswith("<|im_end|>"), F.substr(r, F.lit(1), F.length(r) - 10)).otherwise(r)
        r = F.when(r.endswith("<|eot_id|>"), F.substr(r, F.lit(1), F.length(r) - 10)).otherwise(r)
        if tuned_marker and tuned_marker in family:
            idx = F.instr(r, "Answer:")
            r = F.when(idx > 0, py_strip(F.substr(r, idx + F.lit(7)))).otherwise(r)
        return r
    return r


def with_position_ids(df: DataFrame, seq_keys: Sequence[str], pos: str = "pos", mask: str = "mask",
                      out: str = "position_id") -> DataFrame:
    """C7 at token grain: ``greatest(running sum(mask) - 1, 0)`` per sequence."""
    w = Window.partitionBy(*seq_keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.greatest(F.sum(mask).over(w) - 1, F.lit(0)))


def with_eos_mask(df: DataFrame, seq_keys: Sequence[str], is_eos: str, pos: str = "pos",
                  out: str = "mask") -> DataFrame:
    """C8 at token grain: exclusive running max of the eos flag."""
    w = Window.partitionBy(*seq_keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.max(F.col(is_eos).cast("int")).over(w), F.lit(0))
    return df.withColumn(out, F.when(prior == 1, 0).otherwise(1))


def pack_sequences(df: DataFrame, seq_keys: Sequence[str], budget: int, max_len: int, pos: str = "pos",
                   mask: str = "mask", out: str = "pack") -> DataFrame:
    """C14 re-aimed as sequence packing by token budget: masked tokens are
    dropped, sequences follow each other in key order, and a pack takes those
    that begin inside one stretch of ``budget - max_len + 1`` tokens, so no pack
    exceeds ``budget``.  Each kept token gets its pack, its sequence's offset
    there (``cu_start``) and its own (``packed_pos``).  A sequence of more than
    ``max_len`` tokens fails the job."""
    if not 0 < max_len <= budget:
        raise ValueError("the budget must hold a longest sequence")
    kept = df.filter(F.col(mask) != 0)
    short = F.when(F.col("seq_len") <= max_len, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"a sequence has more than {max_len} tokens")).cast("boolean"))
    lens = kept.groupBy(*seq_keys).agg(F.count(F.lit(1)).alias("seq_len")).filter(short)
    starts = running_sum(lens, seq_keys, "seq_len", "cu_start")
    starts = starts.withColumn(out, F.floor(F.col("cu_start") / (budget - max_len + 1)))
    first = F.min("cu_start").over(Window.partitionBy(out))  # at most `budget` sequences
    starts = starts.withColumn("cu_start", F.col("cu_start") - first)
    j = kept.join(starts, list(seq_keys))
    wpos = Window.partitionBy(*seq_keys).orderBy(pos)
    return j.withColumn("packed_pos", F.col("cu_start") + F.row_number().over(wpos) - 1)


def next_token_labels(packed: DataFrame, pack: str, token: str, order: str = "packed_pos",
                      out: str = "label") -> DataFrame:
    """Labels are the packed stream rolled left by one (the last label of a
    sequence is the next sequence's first token; masked later).  A pack is bounded
    by its token budget."""
    w = Window.partitionBy(pack).orderBy(order)
    return packed.withColumn(out, F.lead(token, 1).over(w))


def assemble_rollout(df: DataFrame, prompt_ids: str, prompt_mask: str, prompt_pos: str, response_ids: str,
                     response_width: int, eos, pad_id: int = 0) -> DataFrame:
    """sequence = prompt ++ padded response; positions continue from the
    last prompt position; mask = prompt mask ++ eos mask of the response."""
    resp = AR.pad_ragged(response_ids, response_width, pad_id)
    return (df.withColumn("responses", resp)
            .withColumn("input_ids", F.concat(col(prompt_ids), F.col("responses")))
            .withColumn("attention_mask", F.concat(col(prompt_mask), AR.eos_mask("responses", eos)))
            .withColumn("position_ids", AR.continue_positions(prompt_pos, response_width)))
