"""tracklattice.plans"""
