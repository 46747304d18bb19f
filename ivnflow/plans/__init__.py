"""Query plans: the flagship feature plan and the registered query catalog."""

from .catalog import ORACLES, QUERIES  # noqa: F401
from . import q_features  # noqa: F401
from . import q_eval  # noqa: F401
from . import q_prepare  # noqa: F401
from . import q_vectors  # noqa: F401
from . import q_stream  # noqa: F401
from . import q_decode  # noqa: F401
