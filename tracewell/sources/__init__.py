"""Part of the tracewell engine: sources"""
