"""Settings of the models behind chat and embedding calls; the calls themselves are the caller's."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass

#: Seconds after which a call is given up.
TIMEOUT_S = 120
_LOCAL = re.compile(r"localhost|127\.0\.0\.1|0\.0\.0\.0|:11434")


@dataclass(frozen=True)
class ModelSettings:
    """Where a model is and how it's asked.

    A local endpoint needs no key. local_only refuses any other endpoint. temperature None: the field is left out.
    """

    base: str
    key: str = ""
    chat_model: str = "gpt-4o-mini"
    embed_model: str = "nomic-embed-text"
    local_only: bool = False
    embeddings: str = ""
    temperature: float | None = 0.0
    timeout_s: int = TIMEOUT_S

    @property
    def local(self) -> bool:
        return bool(_LOCAL.search(self.base))

    @property
    def enabled(self) -> bool:
        return (self.local or bool(self.key)) and (self.local or not self.local_only)

    @property
    def cache_only(self) -> bool:
        """Vectors come from the store alone, and nothing is asked."""
        return self.embeddings == "cache"

    @property
    def embeds(self) -> bool:
        return self.cache_only or (self.enabled and (self.embeddings == "on" or (self.local and self.embeddings != "off")))

    def request(self, messages: list[dict]) -> dict:
        """The body of a chat call."""
        return {"model": self.chat_model, "messages": messages} | ({} if self.temperature is None else {"temperature": self.temperature})


def temperature(setting: str | None) -> float | None:
    """Unset or not a number: 0, so that a slip can't loosen a model. "default": left out."""
    word = (setting or "").strip().lower()
    if word == "default":
        return None
    try:
        value = float(word or 0)
    except ValueError:
        return 0.0
    return value if math.isfinite(value) else 0.0


def settings(env: Mapping[str, str]) -> ModelSettings:
    """From variables MODEL_BASE_URL, MODEL_API_KEY, MODEL_NAME or MODEL_ANSWER, MODEL_EMBED, MODEL_LOCAL_ONLY, MODEL_TEMPERATURE and EMBEDDINGS."""
    get = lambda *names, default="": next((env[n] for n in names if env.get(n)), default)
    return ModelSettings(
        base=get("MODEL_BASE_URL", default="https://api.openai.com/v1").removesuffix("/"), key=get("MODEL_API_KEY"), chat_model=get("MODEL_NAME", "MODEL_ANSWER", default=ModelSettings.chat_model),
        embed_model=get("MODEL_EMBED", default=ModelSettings.embed_model), local_only=env.get("MODEL_LOCAL_ONLY") == "1", embeddings=get("EMBEDDINGS").lower(), temperature=temperature(env.get("MODEL_TEMPERATURE")),
    )
