"""Column expressions: derivations and missing-value rules."""

from trialspark.functions.derive import *  # noqa: F401,F403
from trialspark.functions.missing import *  # noqa: F401,F403
