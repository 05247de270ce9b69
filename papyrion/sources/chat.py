"""Chat models behind an injected transport: requests, answers, pictures, and the choice of a provider.

A transport is a function from a url, headers and a JSON body to a JSON answer. Nothing here opens a
connection by itself unless ``resolve`` is told to use a model.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable, Mapping

from ..operators import enrich

Transport = Callable[[str, Mapping[str, str], dict], dict]


def post(url: str, headers: Mapping[str, str], body: dict) -> dict:
    """The transport that asks over HTTP."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=120) as answer:
        return json.load(answer)


class ChatProvider:
    """A provider of answers by the chat-completions protocol."""

    def __init__(self, key: str, model: str = "gpt-4o-mini", url: str = "https://api.openai.com/v1", vision_model: str | None = None, temperature: float = 0.2, transport: Transport = post):
        self.key, self.model, self.url, self.vision_model, self.temperature, self.transport = key, model, url.rstrip("/"), vision_model or model, temperature, transport

    def chat(self, messages: list[dict], as_json: bool = False, model: str | None = None, max_tokens: int | None = None, temperature: float | None = None) -> dict:
        """content and usage (prompt and completion tokens, if told) of the first answer; message parts are text or image."""
        body = {"model": model or self.model, "messages": [self._message(m) for m in messages], "temperature": self.temperature if temperature is None else temperature}
        if max_tokens is not None:
            body["max_tokens"] = max_tokens
        if as_json:
            body["response_format"] = {"type": "json_object"}
        raw = self.transport(f"{self.url}/chat/completions", {"Authorization": f"Bearer {self.key}"}, body)
        choices, usage = raw.get("choices") or [{}], raw.get("usage")
        return {"content": (choices[0].get("message") or {}).get("content") or "", "usage": usage and (usage["prompt_tokens"], usage["completion_tokens"])}

    @staticmethod
    def _message(m: dict) -> dict:
        if isinstance(m["content"], str):
            return {"role": m["role"], "content": m["content"]}
        part = lambda p: {"type": "text", "text": p["text"]} if p["type"] == "text" else {"type": "image_url", "image_url": {"url": p["url"], "detail": p.get("detail", "auto")}}
        return {"role": m["role"], "content": [part(p) for p in m["content"]]}

    def json(self, messages: list[dict], **options):
        """The answer as a JSON value."""
        return json.loads(self.chat(messages, as_json=True, **options)["content"])

    def describe_image(self, image: str | bytes, prompt: str = "Describe the image in detail.") -> str:
        """What a vision model says of a picture, given as a url or as PNG bytes."""
        url = image if isinstance(image, str) else "data:image/png;base64," + base64.b64encode(image).decode()
        return self.chat([{"role": "user", "content": [{"type": "text", "text": prompt}, {"type": "image", "url": url}]}], model=self.vision_model)["content"]

    def __call__(self, prompts: list[str]) -> list[str]:
        """Answers to enrichment prompts, one call each."""
        return [self.chat([{"role": "user", "content": p}], as_json=True, max_tokens=300)["content"] for p in prompts]


def resolve(spec: str | None, env: Mapping[str, str], transport: Transport = post) -> enrich.Provider:
    """The provider that ``spec`` (``vendor:model``) or a key in the environment asks for; without either the one that answers nothing."""
    key = env.get("OPENAI_API_KEY", "")
    if not spec:
        return ChatProvider(key, transport=transport) if key else enrich.no_model
    vendor, _, model = spec.partition(":")
    if vendor != "openai":
        raise ValueError(f"unknown model vendor {vendor!r}; known: openai")
    return ChatProvider(key, **({"model": model} if model else {}), transport=transport)
