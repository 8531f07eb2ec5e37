"""Named chat templates: registry, special tokens, and the Jinja text of a template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

Slot = str | frozenset

# The end token where a vocabulary has none, and the frame of the Jinja text.
DEFAULT_EOS = "<|endoftext|>"
JINJA_SYSTEM = (
    "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}"
    "{% else %}{% set loop_messages = messages %}{% endif %}{% if system_message is defined %}{{ <system> }}{% endif %}"
)
JINJA_TURNS = (
    "{% for message in loop_messages %}{% set content = message['content'] %}{% if message['role'] == 'user' %}{{ <user> }}"
    "{% elif message['role'] == 'assistant' %}{{ <assistant> }}{% endif %}{% endfor %}"
)


@dataclass(frozen=True)
class ChatTemplate:
    """Slots are texts with {{content}}, or sets that name a special token."""

    user: tuple[Slot, ...] = ("{{content}}",)
    assistant: tuple[Slot, ...] = ("{{content}}", frozenset({"eos_token"}))
    system: tuple[Slot, ...] = ("{{content}}",)
    prefix: tuple[Slot, ...] = ()
    default_system: str = ""
    stop_words: tuple[str, ...] = ()
    replace_eos: bool = False


@dataclass(frozen=True)
class Vocabulary:
    """Special tokens of a tokenizer; None where it has none."""

    bos_token: str | None = None
    eos_token: str | None = None
    pad_token: str | None = None
    stop_words: tuple[str, ...] = field(default=())


TEMPLATES: dict[str, ChatTemplate] = {}


def register(name: str, template: ChatTemplate) -> None:
    if name in TEMPLATES:
        raise ValueError(f"template {name} is registered already")
    TEMPLATES[name] = template


def named(name: str | None, default_system: str | None = None) -> ChatTemplate:
    """The template of a name, with another default system message if one is given."""
    if name not in TEMPLATES:
        raise ValueError(f"no template {name}")
    return TEMPLATES[name] if default_system is None else replace(TEMPLATES[name], default_system=default_system)


def special_tokens(template: ChatTemplate, have: Vocabulary) -> Vocabulary:
    """What the template needs: its first stop word ends turns if it replaces the end token, and the end token pads where no other does."""
    stops, eos = template.stop_words, have.eos_token
    if template.replace_eos:
        if not stops:
            raise ValueError("a stop word is needed to replace the end token")
        eos, stops = stops[0], stops[1:]
    eos = eos or DEFAULT_EOS
    more = tuple(w for w in stops if w not in have.stop_words)
    return Vocabulary(have.bos_token, eos, have.pad_token or eos, have.stop_words + more)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", r"\'") + "'"


def _expression(slots: tuple[Slot, ...], words: Vocabulary, content: str) -> str:
    terms: list[str] = []
    for slot in slots:
        if isinstance(slot, str):
            before, found, after = slot.partition("{{content}}")
            terms += [_quoted(before)] * bool(before) + [content] * bool(found) + [_quoted(after)] * bool(after)
        else:
            token = next((t for n in ("bos_token", "eos_token") if n in slot and (t := getattr(words, n)) is not None), None)
            terms += [f"'{token}'"] * (token is not None)
    return " + ".join(terms)


def jinja_text(template: ChatTemplate, words: Vocabulary) -> str:
    """The template as Jinja text over ``messages``."""
    prefix = _expression(template.prefix, words, "content")
    head = ("{{ " + prefix + " }}") * bool(prefix)
    if template.default_system:
        head += "{% set system_message = " + _quoted(template.default_system) + " %}"
    contents = {"system": "system_message", "user": "content", "assistant": "content"}
    return head + re.sub("<(system|user|assistant)>", lambda m: _expression(getattr(template, m[1]), words, contents[m[1]]), JINJA_SYSTEM + JINJA_TURNS)
