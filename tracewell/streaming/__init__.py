"""Part of the tracewell engine: streaming"""
