"""tracklattice.streaming"""
