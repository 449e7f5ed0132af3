"""tracklattice.functions"""
