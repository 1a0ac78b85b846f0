"""Query wiring: importing this package registers every query."""

from tessera.plans import registry  # noqa: F401
from tessera.plans import series  # noqa: F401
from tessera.plans import profiling  # noqa: F401
from tessera.plans import prep  # noqa: F401
from tessera.plans import evaluation  # noqa: F401
from tessera.plans import textq  # noqa: F401
from tessera.plans import agentq  # noqa: F401
from tessera.plans import arraysq  # noqa: F401
from tessera.plans import modelsq  # noqa: F401
from tessera.plans import io  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
