"""Part of the tracewell engine: llm"""
