"""tracklattice.sources"""
