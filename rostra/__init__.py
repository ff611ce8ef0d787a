"""rostra: corpus analytics (speeches, tokens, document-term tables) as Spark jobs."""

from .model import Corpus  # noqa: F401
from .session import build_session  # noqa: F401
