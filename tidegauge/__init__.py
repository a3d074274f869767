"""A Spark-first engine for monitoring streams and time series.

Layers, each importing only those before it: ``sources`` (readers and domain
tables), ``operators`` (data-processing operators), ``functions`` (expression
registry), ``lang`` (parser), ``plans`` (planner), ``series`` (resampling,
pivots, alerts, replay), ``streaming`` and ``queries``.  The optional
subpackage ``llm`` builds on the rest; nothing else imports it.
"""

__version__ = "0.1.0"
