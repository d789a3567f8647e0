"""Analytics over LLM execution traces as DataFrame operators."""
