"""Query plans: whole workflows put together from operators."""
