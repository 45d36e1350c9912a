"""Part of the tracewell engine: plans"""
