"""tracklattice.operators"""
