from .readers import *  # noqa: F403
from .sinks import *  # noqa: F403
